"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
local cores (default 8), arguments the queries (default: all). Every result is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rankloom.queries import QUERIES  # noqa: E402
from rankloom.session import build_session  # noqa: E402

HEADLINE = [
    "rank_ndcg",
    "ndcg_distinct_k",
    "ranked_list",
    "topk_per_context",
    "submission_order",
    "clean_default",
    "clean_tokens",
    "strip_accents",
    "kfold_exact",
    "fold_report",
    "blend_loss",
    "best_choice",
    "holdout_average",
    "word_ngrams",
    "char_ngrams",
    "vocab_limits",
    "tfidf_word",
    "tfidf_char",
    "tfidf_fold_fit",
    "sentence_vector",
    "weighted_vector",
    "text_features",
    "scale_unit_variance",
    "truncated_svd",
    "linear_oof",
    "gbt_oof",
    "embedding_ranker",
    "word_vector_ranker",
    "blend_models",
    "tsv_lenient",
    "submission_file",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:22} {times[name]:8.3f}s", file=sys.stderr, flush=True)
    spark.stop()
    line = {"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}
    print(json.dumps(line | {"sf": Path(sf).name.removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
