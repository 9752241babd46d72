"""Kept model calls: nothing is asked twice, few calls are open at once; flags of repeated names against plain loops."""

import collections
import os
import signal
import threading
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.operators import catalog as cat
from lumenfold.operators import ledger
from lumenfold.operators import scoring as sc

BUCKETS = 4


@pytest.fixture
def prompted(spark):
    rows = [(i, 0, f"prompt {i}") for i in range(120)] + [(500 + i, 0, "the same\u2028prompt") for i in range(60)] + [(900, 0, None), (901, 0, "")]
    return spark.createDataFrame(rows, "conv_id long, batch int, prompt string").repartition(6)


def counting(log, die_at=None):
    """A backend that logs how many calls are open and the prompt of each; it kills its worker at the call of that number."""
    state = {}

    def backend(system, prompt):
        lock = state.setdefault("lock", threading.Lock())  # made in the worker, as a lock can't be pickled
        with lock:
            state["open"] = state.get("open", 0) + 1
            state["calls"] = state.get("calls", 0) + 1
            with open(log, "a") as f:
                f.write(f"{state['open']}\t{prompt!r}\n")
            last = die_at is not None and state["calls"] >= die_at
        if last:
            os.kill(os.getpid(), signal.SIGKILL)
        time.sleep(0.01)
        with lock:
            state["open"] -= 1
        if prompt == "prompt 7" and die_at is None:
            raise ValueError("seven")
        return f"said {prompt}"

    return backend


def calls(log):
    rows = [x.split("\t") for x in open(log).read().splitlines()] if os.path.exists(log) else []
    return collections.Counter(p for _, p in rows), max((int(n) for n, _ in rows), default=0)


def test_ledger_asks_once_and_few_at_a_time(spark, prompted, tmp_path):
    log, kept = str(tmp_path / "calls"), str(tmp_path / "kept")
    run = lambda: sorted(ledger.complete(prompted, counting(log), kept, max_open=3, every=4, buckets=BUCKETS).collect(), key=lambda r: r.conv_id)
    first = run()
    count, most = calls(log)
    assert len(first) == 182 and set(count.values()) == {1} and len(count) == 122 and 1 < most <= 3
    said = {r.conv_id: (r.raw_output, r.error) for r in first}
    assert said[3] == ("said prompt 3", None) and said[7] == (None, "ValueError: seven") and said[500] == said[559] == ("said the same\u2028prompt", None)
    assert said[900] == said[901] == ("said ", None)
    assert run() == first
    count, _ = calls(log)
    assert count.pop("'prompt 7'") == 2 and set(count.values()) == {1}  # only what failed is asked again
    other = ledger.complete(prompted.filter("conv_id = 3"), counting(log), kept, model="another", buckets=BUCKETS).collect()
    assert other[0].raw_output == "said prompt 3" and calls(log)[0]["'prompt 3'"] == 2
    assert ledger.complete(prompted.limit(0), counting(log), kept, buckets=BUCKETS).count() == 0


def test_ledger_after_a_killed_task(spark, prompted, tmp_path):
    log, kept = str(tmp_path / "calls"), str(tmp_path / "kept")
    with pytest.raises(Exception, match="."):
        ledger.complete(prompted, counting(log, die_at=15), kept, max_open=2, every=3, buckets=BUCKETS).collect()
    had = {k for b in range(BUCKETS) for k in ledger.Bucket(f"{kept}/{BUCKETS}", b).read()}
    keys = {r.key: r.prompt for r in prompted.select(ledger.key_of(F.col("prompt"), "", sc.SYSTEM_PROMPT).alias("key"), F.coalesce("prompt", F.lit("")).alias("prompt")).collect()}
    assert had and had < keys.keys()
    rows = ledger.complete(prompted, counting(log), kept, max_open=2, every=3, buckets=BUCKETS).collect()
    count, _ = calls(log)
    assert len(rows) == 182 and all(count[repr(keys[k])] == 1 for k in had)
    assert sum(count.values()) <= len(keys) + BUCKETS * (3 + 2)  # what was answered and not yet in a file, a bucket


def test_flags_of_repeated_names(spark):
    """The flags are those of numbering each name's rows, and no shuffle is by a name's whole rows."""
    names = ["", " ", "Risk Taking", "RiskTaking", "risk taking", "12. Calm", "Calm", None, "Calm", "Facets:"]
    rows = [(i, names[i % len(names)] if i % 10 == 0 else "") for i in range(400)] + [(400 + i, n) for i, n in enumerate(names)]
    raw = cat.cleaned(spark.createDataFrame(rows, "pos long, raw_facet string"))
    got = cat.flagged(raw)
    before = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("pos")) > 1
    want = raw.withColumn("is_duplicate", before("raw_facet") | ((F.col("normalized_facet") != "") & before("normalized_facet")))
    assert got.columns == [*raw.columns, "is_duplicate", "quality_flag"]
    key = lambda df: sorted((r.pos, r.is_duplicate) for r in df.select("pos", "is_duplicate").collect())
    assert key(got) == key(want) and any(d for _, d in key(got))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert cat.flagged(raw.limit(0)).count() == 0
