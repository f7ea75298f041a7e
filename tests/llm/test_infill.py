"""Fill-in-middle against a plain version, restoration, and equal and long rows."""

import hashlib
import random
import re

import pytest

from plumeline.llm import infill

TYPES = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text, seed=7, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return (doc_id, len(units), "plain", None, None, sha(text), sha(text), text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, len(units), "spm" if h[3] % 100 < spm else "psm", len(prefix), len(middle), sha(out), sha(text), out)


def docs():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a line\n", "é\n", "\n", "no break", "<", "S>", "P>", "\r\n"]) for _ in range(rng.randrange(40)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (None, "x\ny\n"), (None, None), (202, "a<M>b\nc"), (203, "\n"), (204, "\n\n\n"), (5, "again\nand again\n"), (5, "again\nand again\n"), (5, "again\n"), (-3, "minus\nx")]


@pytest.mark.parametrize("settings", [{}, {"seed": 11, "fim_percent": 60, "spm_percent": 20}])
def test_equals_the_plain_version(spark, settings):
    given = docs()
    df = spark.createDataFrame([(*d, 1, "f") for d in given], f"{TYPES}, n int, form string")
    found = infill.fill_in_middle(df, texts=True, **settings)
    want = [plain(*d, settings.get("seed", 7), settings.get("fim_percent", 100), settings.get("spm_percent", 50)) for d in given]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_small_pieces_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(infill, "PIECE", 3)
    given = docs()
    rows = [r for d in given for r in infill.emitted([(d[0], d[1] or "")], infill.Settings())]
    back = infill.assembled(sorted(rows, key=lambda kv: kv[0]), True)
    out = sorted(infill.rebuilt(sorted(back, key=lambda kv: kv[0]), True), key=repr)
    assert out == sorted((plain(*d) for d in given), key=repr)


def test_text_is_shuffled_once(spark):
    full = spark.createDataFrame([(1, "a\nb")], TYPES)
    found = infill.fill_in_middle(full)
    assert found.rdd.toDebugString().decode().count("ShuffledRDD") + found.rdd.toDebugString().decode().count("PartitionwiseSampledRDD") <= 1


def test_equal_rows_are_sent_once_and_counted(spark):
    rows = [(7, "same\ntext\n")] * 500
    sent = list(infill.emitted(rows, infill.Settings()))
    assert len(sent) < 8
    found = infill.fill_in_middle(spark.createDataFrame(rows, TYPES).repartition(4))
    assert {tuple(r) for r in found.collect()} == {plain(7, "same\ntext\n")[:-1]} and found.count() == 500


def test_long_texts_and_empty_tables(spark):
    long = [(1, "z" * 2_000_000), (2, "y\n" * 400_000)]
    found = infill.fill_in_middle(spark.createDataFrame(long, TYPES)).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain(*d)[:-1] for d in long)
    assert infill.fill_in_middle(spark.createDataFrame([], TYPES)).isEmpty()
    assert infill.fill_in_middle(spark.createDataFrame([(1, None)], TYPES)).count() == 1


def test_restoration_reads_the_output_only():
    for doc in docs():
        _, _, form, *_, output = plain(*doc)
        assert infill.restored(output, form) == (doc[1] or "")
        reader = infill.Reader(form)  # byte by byte
        parts = ([], [], [])
        for i in range(len(output.encode())):
            for rank, piece in reader.feed(output.encode()[i : i + 1]):
                parts[rank].append(piece)
        for rank, piece in reader.end():
            parts[rank].append(piece)
        assert b"".join(b"".join(p) for p in parts).decode() == (doc[1] or "")
    with pytest.raises(ValueError):
        infill.restored("no marker", "psm")
    with pytest.raises(ValueError):
        infill.restored("<P>a<S>b", "psm")
