"""Time the headline queries: one JSON line, the median seconds of three runs per query, and their sum."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from tagloom.plans import catalog
from tagloom.runtime import release_scratch
from tests.session import local_session

HEADLINE = [
    "f03_search_page",
    "f03_tags_regex",
    "c01_parse_caption",
    "c08_prioritise",
    "c20_sort_by_ladder",
    "c21_deoverlap",
    "c23_formalise",
    "c36_optimise",
    "a02_tag_frequency",
    "a03_co_occurrence",
    "a04_features_from_counts",
    "j05_post_tags",
    "j07_diff",
    "j08_defeature",
    "o01_sort_multi",
    "o04_upsert",
    "o11_compact_edits",
    "o12_index_delta",
    "s08_first_source_wins",
    "u06_predicted_captions",
    "w04_batches_shuffled",
    "x02_drop_near_duplicates",
]


RUNS = 3


def run(df) -> None:
    """Compute the whole result without bringing it to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    run(catalog.QUERIES["f03_search_page"](spark, folder))  # warm up the JVM and the file cache
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run(catalog.QUERIES[name](spark, folder))
            times.append(time.perf_counter() - start)
            release_scratch(spark)
        seconds[name] = round(median(times), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
