"""Seconds per query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is written to a sink that keeps nothing, so all its columns are computed. The time is the better of two
runs: the second no longer pays for code generation and Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sheafwork.catalog import QUERIES
from sheafwork.session import build_session

HEADLINE = (
    "invoice_anomaly_counts extract_dates extract_totals extract_vendor field_anomalies classify_keywords to_markdown "
    "fuse_confidence_vote fuse_similarity rebuild_table_grid sort_blocks document_text_and_confidence exact_duplicates "
    "document_detail keyword_documents type_counts_top10 dominant_colors color_palette chunk_text "
    "build_text_index_unstemmed build_text_index search_fulltext knn_l2 knn_inner_product zero_shot_labels "
    "near_duplicate_pairs near_duplicate_groups next_version apply_document_patch pack_context stream_quiet_batches "
    "match_vendor_fuzzy html_corpus_to_text email_corpus_to_rows predict_type snippet search_results hybrid_results "
    "rebuild_index stream_dedup stream_hot_folder ingest_documents"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
