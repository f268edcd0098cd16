"""Fill-in-middle: boundary sets, a plain version with a regular expression, round trip."""

import hashlib
import random
import re

import numpy as np
import pytest

from vitrine.llm import fim
from vitrine.llm.queries import QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def plain(doc_id, text):
    """The contract, word by word."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    hexes = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[8 * i : 8 * i + 8], 16) for i in range(4))
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text))
    return (doc_id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text))


@pytest.mark.parametrize("kind, places", [
    (fim.Array, [0, 5, 9, 65535]),
    (fim.Bitmap, sorted(random.Random(1).sample(range(65536), 20_000))),
    (fim.Bitmap, list(range(1, 65536, 2))),
    (fim.Runs, [*range(100, 9000), *range(20_000, 20_004)]),
    (fim.Runs, list(range(65536))),
])
def test_containers(kind, places):
    made = fim.container(np.array(places))
    assert type(made) is kind
    some = range(len(places)) if len(places) < 5000 else [0, 1, 63, 64, 65, 4095, len(places) // 2, len(places) - 1]
    assert all(made.select(r) == places[r] for r in some)


def test_boundaries_over_many_containers():
    rng = random.Random(3)
    places = sorted({*rng.sample(range(400_000), 900), *range(131_000, 140_000), *range(200_000, 262_000, 3)})
    bounds = fim.Boundaries(np.array(places))
    assert {type(c) for c in bounds.containers} == {fim.Array, fim.Bitmap, fim.Runs} and len(bounds) == len(places)
    assert [bounds.select(r) for r in range(0, len(places), 7)] == places[::7]
    assert bounds.cut(0) == 0 and bounds.cut(len(places)) == places[-1] and len(fim.Boundaries(np.array([], int))) == 0


ODD = [
    None, "", " ", "\t\n", "a", " a", "a ", " a  b\n", "x<P>y", "<S>", "a<M", "<M <S <P", "<<", "a b c d", "é 😀 漢字\r\nz", "a\x0bb\x0cc\x1cd",
    "w " * 40_000, "long" * 60_000 + " end", "\n" * 70_000, "😀 " * 50_000, "a < S> b >", "<", "S> P> M>", "x<", "<P <S <M x",
]


def test_equals_plain_version(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("ab <>PSM\t\né😀", k=rng.randint(0, 40))) for _ in range(600)]
    rows = [(None if i % 97 == 5 else i * 7 - 900, t) for i, t in enumerate(texts * 2)]
    rows += rows[:40]
    out = fim.digests(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str(plain(*r)) for r in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = QUERIES["op13_fill_in_middle"](spark, SF)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(plain(r.doc_id, r.text)) for r in docs)


def test_odd_tables(spark):
    assert fim.digests(fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    clash = "doc_id long, text string, n int, output string, form string, `made of` string, `a.b` int"
    rows = [(1, "a b c", 3, "o", "f", "m", 1), (1, "a b c", 3, "o", "f", "m", 1), (None, None, None, None, None, None, None)]
    out = fim.digests(fim.fill_in_middle(spark.createDataFrame(rows, clash))).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str(plain(r[0], r[1])) for r in rows)
    other = fim.fill_in_middle(spark.createDataFrame([(4, "x y")], "text long, form string"), key="text", text="form", rate=100, spm_rate=0)
    row = other.first()
    assert row["output"].startswith("<P>") and other.columns[0] == "text"
