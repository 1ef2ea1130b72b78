"""Chooses LIFT and BIAS on a fold inside the learning rows: learns where crc32 leaves 2, looks where it leaves 0.

Rows that are held out (1) play no part. Run by hand: python tests/llm/tune_toxicity.py FOLDER...
"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from chronolode.llm import toxicity
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    for folder in sys.argv[1:]:
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").filter(part != 1)
        labels = spark.read.parquet(f"{folder}/labels.parquet").filter(part != 1)
        seen = docs.join(labels.filter((part == 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic"), "doc_id").cache()
        for lift in (5, 10, 20, 40):
            for bias in ((-9.0, -5.0), (-7.0, -3.0)):
                model = toxicity.fit(docs, labels.filter(part == 2), lift=lift, bias=bias)
                rows = toxicity.score(seen, model).groupBy("toxic", "predicted").count().collect()
                n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
                hit, false, miss = n.get((1, 1), 0), n.get((0, 1), 0), n.get((1, 0), 0)
                print(folder, lift, bias, f"precision {hit / max(hit + false, 1):.4f} recall {hit / max(hit + miss, 1):.4f} rows {sum(n.values())}", flush=True)
