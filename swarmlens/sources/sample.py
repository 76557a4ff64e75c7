"""Sample posts, and posts given as literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.sources.adapters import WHITE

#: The demonstration's campaigns, each with its texts and the accounts that post them in turn.
CAMPAIGNS = {
    "crypto": (
        ["Check out this amazing deal on crypto! 🚀💰", "Check out this incredible deal on crypto! Don't miss out!", "Amazing crypto deal alert! Check it out now!", "Don't miss this amazing deal on cryptocurrency!", "Check out this unbelievable crypto opportunity!"],
        ["cryptobot1", "dealfinder2", "coinmaster3", "trader_pro", "crypto_alert"],
    ),
    "follow": (
        ["Follow for follow back, guaranteed! #FollowForFollow", "F4F - Follow for follow back guaranteed!", "Follow me and I'll follow back immediately!", "Guaranteed follow back! Just follow me first", "Following everyone back who follows me!", "F4F guaranteed follow back #follow4follow"],
        ["followback1", "f4f_user", "followme123", "socialmedia_pro", "insta_follow", "followtrain"],
    ),
    "income": (
        ["Make $1000 a day working from home! No experience needed!", "Earn $1000 daily from home - easy work!", "Work from home and make $1000 per day guaranteed!", "$1000/day working from home - click link to start!", "Make money from home - $1000 daily possible!", "Home-based work: earn $1000 every single day!"],
        ["workfromhome1", "money_maker", "home_income", "easy_money", "daily_cash"],
    ),
    "suspension": (
        ["URGENT: Your account will be suspended! Click here to verify", "Account suspension warning - immediate action required!", "Your account is at risk of suspension - verify now!", "ALERT: Account suspension in 24 hours - click to prevent", "Urgent account verification needed to avoid suspension"],
        ["security_alert", "account_support", "verification_team", "urgent_notice", "admin_alert"],
    ),
    "legitimate": (
        ["Just had an amazing coffee this morning! ☕", "Beautiful sunset today, feeling grateful 🌅", "Working on a new project, excited to share updates soon!", "Reading a great book about machine learning algorithms", "Had a wonderful dinner with friends last night", "Learning Go programming language, it's quite interesting!", "The weather is perfect for a walk in the park today", "Just finished watching an incredible documentary about space"],
        ["coffee_lover", "nature_fan", "developer_joe", "ai_researcher", "socialite_sam", "gopher_dev", "walker_mike", "space_enthusiast"],
    ),
}


def sample_rows() -> list[tuple[str, str, str]]:
    """(campaign, username, text) of the sample."""
    return [(name, users[i % len(users)], text) for name, (texts, users) in CAMPAIGNS.items() for i, text in enumerate(texts)]


def literal_posts(spark: SparkSession, rows: list[tuple[str | None, str | None]]) -> DataFrame:
    """(username, text) of given rows: blank texts are left out, a blank name is made from the text's hash."""
    df = spark.createDataFrame(rows, "text string, username string").where(F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE)) != "")
    made = F.concat(F.lit("user_"), F.crc32("text").cast("string"))
    return df.select(F.when(F.btrim(F.coalesce("username", F.lit("")), F.lit(WHITE)) == "", made).otherwise(F.col("username")).alias("username"), "text")
