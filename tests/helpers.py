"""Small fixtures in the library's schemas."""

from datetime import datetime

from pyspark.sql import functions as F

from nightdesk.schemas import WIN_EVENT

ORDER = [part.split()[0] for part in WIN_EVENT.replace("\n", " ").split(",") if part.strip()]
ARRAYS = {
    "Account_Name", "Target_Account_Name", "Subject_Account_Name", "Subject_Account_Domain",
    "Member_Account_Name", "Caller_Computer_Name", "Object_DN",
}


def at(text):
    return datetime.fromisoformat(f"2024-03-05 {text}" if len(text) < 10 else text)


def events(spark, rows):
    """Security events from dicts; ``time`` is ``HH:MM:SS`` or a full stamp."""
    filled = []
    for row in rows:
        row = {
            "host": "DC01", "index": "wineventlog", "sourcetype": "WinEventLog:Security", **row,
            "_time": str(at(row["time"])),
        }
        filled.append(tuple(row.get(c) for c in ORDER))
    df = spark.createDataFrame(filled, WIN_EVENT.replace("_time timestamp", "_time string"))
    return df.withColumn("_time", F.col("_time").cast("timestamp"))


def failure(time, account="bob", ip="10.1.1.1", **more):
    names = ["DC01$"] if account is None else ["DC01$", account]
    return {"time": time, "EventCode": "4625", "Account_Name": names, "IpAddress": ip, "Logon_Type": "3",
            "Status": "0xC000006D", "Sub_Status": "0xC000006A", **more}


def lockout(time, account="bob", source="WS1", **more):
    return {"time": time, "EventCode": "4740", "Account_Name": [account], "Caller_Computer_Name": [source], **more}


def policy(time, actor, code="5136", **more):
    return {"time": time, "EventCode": code, "Subject_Account_Name": None if actor is None else [actor],
            "Object_Class": "groupPolicyContainer", **more}


def rows(df):
    return [tuple(r) for r in df.collect()]
