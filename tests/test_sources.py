import io
import math
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwork.operators import similarity
from siftwork.plans import moderation
from siftwork.sources import documents, images, providers, sinks, uploads

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, members=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


def paragraph(x):
    return f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"


def test_docx(spark):
    row = f"<w:tbl><w:tr><w:tc>{paragraph('a')}</w:tc><w:tc>{paragraph(' ')}</w:tc><w:tc>{paragraph('b')}</w:tc></w:tr></w:tbl>"
    files = {
        "good": docx(paragraph("one") + paragraph(" ") + row, [("word/media/i.png", b"x")]),
        "bomb": docx("", [("big", b"0" * 5_000_000)]),
        "run": docx("", [("setup.EXE", b"x")]),
        "junk": b"not a zip",
        "empty": b"",
    }
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    found = {r["path"]: r for r in documents.extract(df).collect()}
    assert found["good"]["text"] == "one\na | b" and found["good"]["n_images"] == 1
    assert {k: r["error"] for k, r in found.items()} == {
        "good": None, "bomb": "compression_ratio", "run": "executable_member", "junk": "unreadable", "empty": "unreadable",
    }


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 20, 30) + b"\0" * 8
    files = [("p", png), ("g", b"GIF89a" + struct.pack("<HH", 9, 8)), ("j", jpeg), ("x", b"?"), ("big", png[:16] + struct.pack(">II", 10000, 5000))]
    found = {r["path"]: (r["width"], r["height"], r["status"]) for r in images.with_sizes(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert found == {
        "p": (640, 480, "ok"), "g": (9, 8, "ok"), "j": (30, 20, "ok"), "x": (None, None, "corrupt"), "big": (10000, 5000, "too_many_pixels"),
    }


def plain_measures(x):
    """The same measures pixel by pixel."""
    h, w = len(x), len(x[0])
    at = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    laplace = [[x[at(i - 1, h)][j] + x[at(i + 1, h)][j] + x[i][at(j - 1, w)] + x[i][at(j + 1, w)] - 4 * x[i][j] for j in range(w)] for i in range(h)]
    flat = [v for r in laplace for v in r]
    mean = sum(flat) / len(flat)
    strokes = [x[i][j] // 8 for i in range(h) for j in range(w) if abs(laplace[i][j]) > 30]
    shares = [strokes.count(b) / len(strokes) for b in set(strokes)]
    return {
        "sharpness": sum((v - mean) ** 2 for v in flat) / len(flat),
        "text_density": sum(abs(v) > 50 for v in flat) / len(flat),
        "entropy": -sum(p * math.log2(p) for p in shares) / 5 if strokes else 0.0,
    }


def test_grey_measures():
    flat = images.grey_measures(np.full((8, 8), 7))
    assert flat == {"sharpness": 0.0, "text_density": 0.0, "edge_density": 0.0, "entropy": 0.0}
    rng = np.random.default_rng(1)
    for size in ((9, 13), (2, 2), (30, 17)):
        x = rng.integers(0, 256, size)
        want = plain_measures(x.tolist())
        found = images.grey_measures(x)
        assert {k: found[k] for k in want} == pytest.approx(want)
        assert 0 <= found["edge_density"] <= 1
    # a step has one line of edges
    step = np.zeros((20, 20))
    step[:, 10:] = 200
    assert images.edges(step).sum(1).tolist() == [1] * 20
    assert images.grey_measures(np.zeros((0, 0)))["entropy"] == 0.0
    assert images.grey_measures(np.ones((1, 5)))["sharpness"] == 0.0


def test_measures_and_gates_of_a_table(spark):
    x = np.random.default_rng(2).integers(0, 256, (6, 7)).astype(np.uint8)
    df = spark.createDataFrame([(1, 7, bytearray(x.tobytes())), (2, 7, bytearray(b"12345")), (3, 7, None), (4, 0, bytearray(b"1"))], "image long, width int, pixels binary")
    found = {r["image"]: r for r in images.measured(df).collect()}
    assert found[1]["text_density"] == pytest.approx(images.grey_measures(x)["text_density"])
    assert all(found[i]["entropy"] is None for i in (2, 3, 4))
    gates = spark.createDataFrame([(["Book"], None, None), ([], 0.02, 0.0), ([], 0.0, 0.06), ([], 0.0, 0.0), (None, None, None)], "c array<string>, d double, e double")
    assert [r[0] for r in gates.select(images.text_gate(F.col("c"), F.col("d"), F.col("e"))).collect()] == [True, True, True, False, False]
    sizes = spark.createDataFrame([(31, 90, 99.0), (32, 90, 39.0), (32, 90, 40.0), (None, 90, 40.0)], "w int, h int, s double")
    assert [r[0] for r in sizes.select(images.quality_gate(F.col("w"), F.col("h"), F.col("s"))).collect()] == ["LOW_RES", "BLUR", "OK", "CORRUPT"]


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "safe").mkdir()
    (tmp_path / "safe" / "a.png").write_bytes(b"1")
    (tmp_path / "b.txt").write_bytes(b"22")
    files = uploads.read_files(spark, str(tmp_path), "*.png").collect()
    assert [(r["path"].rsplit("/", 2)[-2], r["length"]) for r in files] == [("safe", 1)]
    pages = spark.createDataFrame([(80, False), (81, False), (1, True)], "n int, locked boolean")
    assert [r[0] for r in pages.select(documents.pages_status(F.col("n"), F.col("locked"))).collect()] == ["ok", "too_many_pages", "encrypted"]


def test_a_document_shows_its_first_text_and_links(spark):
    text = "see " + " ".join(f"https://a.b/{i:03d}" for i in range(60)) + " x" * 3000
    row = moderation.moderate_documents(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0]["preview"] == text[:2000] and len(row[0]["first_links"]) == 50 and row[1]["preview"] == ""


@pytest.mark.parametrize("n, share, most", [(1000, 0.1, 100), (1000, 0.95, 100), (50, 0.1, 100), (300, 0.0, 100)])
def test_trim_oldest(spark, monkeypatch, n, share, most):
    keys = np.random.default_rng(4).permutation(n * 3)[:n].tolist()
    left = similarity.trim_oldest(spark.createDataFrame([(k, "x") for k in keys], "k long, v string"), share, most, "k", buckets=7, ranked=20)
    gone = max(1, int(n * share)) if n > most else 0
    assert sorted(r["k"] for r in left.collect()) == sorted(keys)[gone:]
    equal = similarity.trim_oldest(spark.createDataFrame([(5, "x")] * 30, "k long, v string"), 0.5, 10, "k")
    assert equal.count() == 15


@pytest.mark.parametrize(
    "url, status", [("https://a.b/c", "ok"), ("ftp://a.b", "bad_scheme"), ("https:///x", "no_host"), ("http://u:p@a.b", "has_user"), ("x", "bad_scheme")]
)
def test_urls(spark, url, status):
    assert spark.range(1).select(uploads.url_status(F.lit(url))).first()[0] == status


@pytest.mark.parametrize("host, private", [("10.0.0.1", True), ("172.20.1.1", True), ("8.8.8.8", False), ("example.com", False), ("192.168.0.9", True)])
def test_private_addresses(spark, host, private):
    assert spark.range(1).select(uploads.is_private_address(F.lit(host))).first()[0] is private


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, 0.5, "x")], "n int, share double, name string")
    assert {(r["metric"], r["value"]) for r in sinks.as_metrics(df).collect()} == {("n", 3.0), ("share", 0.5)}
    assert sinks.as_json(df).first()[0] == '{"n":3,"share":0.5,"name":"x"}'
    assert sinks.exposition(df, "hits", ["name"], "n").first()[0] == 'hits{name="x"} 3'
    sinks.write_metrics(sinks.as_metrics(df), str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 2


def test_provider_and_verdict(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    scored = providers.with_provider(df, "text", lambda s: pd.DataFrame({"toxicity": s.str.len() / 10.0}), ["toxicity"])
    assert {r["id"]: r["toxicity"] for r in scored.collect()} == {1: 0.3, 2: 0.0}
    answers = spark.createDataFrame([('so: {"decision": "rejected", "confidence": 7, "reason": "r"} end',), ("none",)], "a string")
    got = [tuple(r) for r in answers.select(*[v.alias(k) for k, v in providers.parse_verdict(F.col("a")).items()]).collect()]
    assert got == [("REJECTED", "r", 1.0, ""), ("UNDER_REVIEW", "", 0.5, "")]
