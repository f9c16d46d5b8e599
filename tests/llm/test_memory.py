"""What Python workers hold: freed memory goes back after a task, and a task needs one worker."""

import re
from pathlib import Path

import numpy as np

from stratalens.llm import suffix_dedup
from stratalens.llm.common import lean


def held_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_freed_memory_goes_back_at_the_end_of_a_task():
    def run(batches):
        pinned = []
        for n in batches:
            made = [np.ones(200) for _ in range(n)]
            pinned.append(made.pop())  # lies above what is freed, so the heap's top cannot shrink
            yield made and len(pinned)
            del made
        kept.extend(pinned)

    kept = []
    before = held_mb()
    assert list(lean(run)(iter([100_000]))) == [1]
    assert held_mb() - before < 50


def test_words_and_bytes_are_sampled_by_one_operator(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), 2)], "doc_id long, text string, row_key long")
    made = suffix_dedup.samples(docs, 400, 300, words=True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow|Union", plan)) == 1
    # 60 words are 480 letters of marks, but as text fewer than 400 bytes
    assert {r.row_key for r in made.collect()} == {3}
