
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import SparkSession, functions as F

    from policyspark.operators import domains as dm, hosts as hs, text_policy as tp
    from policyspark.plans.text import LEXICON
    from policyspark.sources import lists as ls

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str, n: int, job) -> None:
        for _ in range(2):
            start = time.time()
            job().write.format("noop").mode("overwrite").save()
            took = time.time() - start
        print(f"{name}: {took:.1f} s, {n / took:,.0f} rows/s", flush=True)

    word = lambda c: F.substr(F.sha1(c.cast("string")), F.lit(1), F.lit(8))
    name = F.concat(F.concat(F.lit("h"), word(F.col("id") % 700_000)), F.lit(".site"), (F.col("id") % 5000).cast("string"), F.lit(".com"))
    lines = spark.range(1_000_000).select(F.concat(F.lit("src"), (F.col("id") % 3).cast("string")).alias("source"), F.lit("adult").alias("category"), F.lit("plain").alias("format"), name.alias("value"))
    suffixes, none = spark.createDataFrame([("com",), ("co.uk",)], "rule string"), spark.createDataFrame([], "value string")
    timed("merge of 10^6 lines from three sources", 1_000_000, lambda: dm.merge(dm.classified(ls.raw_entries(lines), suffixes, none)))
    listed = spark.range(10_000).select(F.concat(F.lit("site"), (F.col("id") % 5000).cast("string"), F.lit(".com")).alias("domain")).distinct()
    rules = listed.select(F.lit(1).alias("seq"), "domain", F.lit("block").alias("action"))
    empty = spark.createDataFrame([], "domain string")
    bulk = spark.range(1_000_000).select(F.concat(F.lit("h"), word(F.col("id")), F.lit(".site"), (F.col("id") % 5000).cast("string"), F.lit(".com")).alias("domain"), F.lit("apex").alias("scope"))
    for n in (100_000, 1_000_000):
        hosts = spark.range(n).select(name.alias("host"))
        timed(f"host policy of {n:,} hosts, 5,000 rules, 10^6 list entries", n, lambda hosts=hosts: hs.resolve(hosts, empty, rules, bulk))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(16)
    more = [(100 + i, f"term{i} of", "x", "low", ["exact_phrase", "token_sequence"]) for i in range(990)]
    timed("text verdicts, 10 terms", 10_000, lambda: tp.verdicts(docs, tp.lexicon_table(spark, LEXICON)))
    timed("text verdicts, 1,000 terms", 10_000, lambda: tp.verdicts(docs, tp.lexicon_table(spark, LEXICON + more)))


if __name__ == "__main__":
    main()
