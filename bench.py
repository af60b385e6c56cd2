"""Seconds of the headline queries, warm: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from folioscope.plans import catalog
from folioscope.session import session

HEADLINE = (
    "doc_quality_metrics", "doc_quality_findings", "prose_totals_by_lang", "term_frequency", "smoothed_idf", "tfidf_cosine_topk", "token_overlap",
    "finding_fingerprint", "baseline_suppression", "findings_summary", "guard_classify", "severity_rollup", "surface_sync", "spec_divergence",
    "cap_with_remainder", "indirect_impact", "secret_scan", "heading_slugs", "broken_links", "freshness", "instruction_duplicates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", **{"spark.sql.shuffle.partitions": "16", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
