"""python -m tests.llm.recall SF_DIR: recall of the pivot index on its embeddings, against all pairs."""

import os
import sys

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wachter.llm.embedding_neardup import THRESHOLD, near_duplicates


def main(sf_dir: str) -> None:
    spark = SparkSession.builder.master(f"local[{os.cpu_count()}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g").getOrCreate()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = near_duplicates(vectors).agg(F.sum("n_links")).first()[0] // 2
    x = np.stack([r[0] for r in vectors.where("embedding is not null").select("embedding").collect()]).astype(float)
    x = x[np.isfinite(x).all(1) & x.any(1)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = sum(int((u[i : i + 1000] @ u.T >= THRESHOLD).sum()) for i in range(0, len(u), 1000)) - len(u)
    print(f"{len(u)} vectors, {pairs // 2} pairs of at least {THRESHOLD}, found {found}: recall {found / max(1, pairs // 2):.4f}")


if __name__ == "__main__":
    main(sys.argv[1])
