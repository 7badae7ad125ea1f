"""Results that differed from their SQL, or work that grew too fast, on larger tables: small tables that show the same."""

import random
import re

import duckdb
import pyarrow as pa
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from siftwork.functions import detectors
from siftwork.operators import similarity
from siftwork.plans import registry


def small_tables(folder, **tables):
    """Writes each table, a SELECT, as one Parquet file, or as several if it is a list; the folder, and views of the tables."""
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for name, selects in tables.items():
        at = folder / f"{name}.parquet"
        if isinstance(selects, list):
            at.mkdir()
            for i, s in enumerate(selects):
                c.execute(f"copy ({s}) to '{at}/part-{i:04}.parquet' (format parquet)")
        else:
            c.execute(f"copy ({selects}) to '{at}' (format parquet)")
        c.execute(f"create view {name} as select * from '{at}{'/*.parquet' if isinstance(selects, list) else ''}'")
    return str(folder), c


def test_ordinals_follow_files_not_their_sizes(spark, tmp_path):
    # Spark deals larger files first
    parts = [f"select 1000 * {i} + range as doc_id, repeat('x', 50) as text from range({n})" for i, n in enumerate((3, 400, 0, 20, 4000))]
    folder, c = small_tables(tmp_path, documents=parts)
    assert_same(registry.QUERIES["batch_ordinals"](spark, folder), registry.ORACLES["batch_ordinals"], c)


@pytest.mark.parametrize("size", [101, 104, 105, 106, 115, 125, 128])
def test_trim_drops_the_nearest_number_of_entries(spark, tmp_path, size):
    folder, c = small_tables(tmp_path, embeddings=f"select range as vec_id, (range % 7)::int as label from range({size})")
    assert_same(registry.QUERIES["cache_trim"](spark, folder), registry.ORACLES["cache_trim"], c)


@pytest.mark.parametrize("name", ["mon_history", "mon_history_10s", "mon_rates"])
def test_ages_are_counted_in_seconds_to_the_nearest(spark, tmp_path, name):
    # the newest event is at .7 s; the others are at every tenth of a second around the borders of windows
    at = "timestamp '2024-01-30 23:59:25.7' - to_milliseconds(100 * range) - to_seconds(width)"
    events = (
        f"select row_number() over () as event_id, {at} as ts, range % 9 as user_id, 'view' as event_type, 1.0::double as value, '{{}}' as props "
        "from range(30), (select unnest([0, 8, 58, 298, 598, 3598, 7198]) as width)"
    )
    folder, c = small_tables(tmp_path, events=events)
    assert_same(registry.QUERIES[name](spark, folder), registry.ORACLES[name], c)


def test_labels_and_prompts_of_an_image_are_normalised_once(spark, sf_dir):
    plan = registry.QUERIES["image_moderation"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2


def test_vectors_leave_a_task_in_slices(monkeypatch):
    monkeypatch.setattr(similarity, "SLICE_BYTES", 8 * 3 * 10 * 4)
    vectors = [[float(i + j) for j in range(3)] if i % 5 else [1.0] for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(vectors, pa.list_(pa.float64()))], ["key", "v"])
    slices = list(similarity._by_length(batch, copies=10))
    assert sorted(k for part, _ in slices for k in part.column("key").to_pylist()) == list(range(40))
    assert all(v.size * 8 * 10 <= similarity.SLICE_BYTES and len(part) == len(v) for part, v in slices)


def test_personal_data_patterns_run_where_they_can_match_alone(spark):
    random.seed(5)
    bits = ["@", "a", "b.co", "ok", " ", "-", "0", "9", "6789", "12345", "1234 5678", "ABCDE", "x_", "A1234567", "SBIN0", "flat", "٣٤٥٦٧", "://", "http"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    t = F.col("t")
    plain = {
        "pan": t.rlike(detectors.PAN), "passport": t.rlike(detectors.PASSPORT), "phone": t.rlike(detectors.PHONE), "email": t.rlike(detectors.EMAIL),
        "address": t.rlike(detectors.ADDRESS) & t.rlike("[0-9]"), "aadhaar": F.exists(F.regexp_extract_all(t, F.lit(detectors.AADHAAR_ALONE), F.lit(0)), detectors._aadhaar_digits),
        "bank": t.rlike(detectors.UPI) | t.rlike(detectors.IFSC)
        | F.exists(F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0)), lambda d: F.length(d).between(9, 18) & ~detectors._aadhaar_digits(d)),
    }
    links = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(detectors.LINK), F.lit(0))))
    flags = detectors.pii_flags(t)
    found = df.select(*[flags[k].eqNullSafe(v).alias(k) for k, v in plain.items()], detectors.links(t).eqNullSafe(links).alias("links"))
    assert all(all(r) for r in found.collect())
    plan = df.select(*[v.alias(k) for k, v in flags.items()], detectors.links(t).alias("links"))._jdf.queryExecution().optimizedPlan().toString()
    checks = [len(re.findall(p, plan)) for p in (r"Contains\(t", r"RLIKE\(t#\d+, \[0-9\]\{4\}\)", r"RLIKE\(t#\d+, \[0-9\]\{5\}\)")]
    assert checks == [4, 2, 3]
