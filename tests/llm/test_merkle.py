import hashlib
import zlib

import pytest
from brute import DOCS
from pyspark.sql import functions as F

from marquee.llm import merkle
from marquee.llm.repair import folder

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H(*[field(v) for v in (r[0], r[3], r[2], r[4], text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([H(*own[i : i + 3]) for i in range(0, len(own), 3)])
    return levels


def path(levels, i):
    out = []
    for own in levels[:-1]:
        run = own[i // 3 * 3 : i // 3 * 3 + 3]
        out.append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        i //= 3
    return out


def plain(rows):
    """Rows of the audit by whole trees in memory."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in by:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: tree([leaf(r, r[1]) for r in by[s]]) for s in by}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(by[s]):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            steps = path(trees[s], i) + path(top, at)
            for place, others in steps:
                node = H(*others[:place], node, *others[place:])
            root = top[-1][0]
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], root, H(*[x for _, o in steps for x in o]), node, node == root))
    return sorted(out, key=str)


def audited(spark, rows, extra=(), stride=4):
    df = spark.createDataFrame(rows, DOCS)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    manifest = merkle.build(df, folder(spark, "manifest"), merkle.tampered(), stride)
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in manifest.audit().select(*cols).collect()), key=str)


def corpus(n, sources):
    return [(i * 7 % n, f"text\n{i}\n" if i % 3 else f"text {i}", "en" if i % 4 else None, f"s{i % sources}" if i % 5 else "hot", i if i % 2 else None) for i in range(n)]


@pytest.mark.parametrize("n,sources,stride", [(1, 1, 4), (4, 3, 1), (4, 3, 4), (83, 1, 2), (83, 1, 4), (400, 90, 2)])
def test_against_whole_trees(spark, n, sources, stride):
    rows = corpus(n, sources)
    assert audited(spark, rows, extra=("key", "name", "digest", "i", "n", "block", "claim", "path"), stride=stride) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "a\nb", "en", None, 1), (3, "", "", "", 0), (3, "", "", "", 0), (3, "x\ny", "é", "é", -5),
        (4, "-", "-", "-", 1), (5, None, "zh", "\U0001f600", 2**62), (6, "q\n" * 50000, "en", "￿", 3), (2**60 + 1, "\n", None, "é", None),
    ]
    assert audited(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert audited(spark, []) == []


def test_proofs_fold_to_the_root_and_no_other_leaf_does(spark):
    df = spark.createDataFrame(corpus(200, 3), DOCS)
    manifest = merkle.build(df, folder(spark, "manifest"))
    rows = manifest.proofs().collect()
    for r in rows:
        assert merkle.fold(r["leaf"], merkle.parsed(r["path"])) == r["root"]
        assert merkle.fold("0" * 64, merkle.parsed(r["path"])) != r["root"]
    assert all(r["claim"] is None for r in rows)


def test_only_every_few_levels_are_stored(spark):
    path = folder(spark, "manifest")
    manifest = merkle.build(spark.createDataFrame(corpus(400, 1), DOCS), path)
    assert (manifest.rows, manifest.sources) == (2, 1)
    nodes = [spark.read.parquet(f"{path}/rows/{k}").agg(F.sum(F.size("digest"))).first()[0] for k in range(2)]
    # The larger source has 320 leaves; of its six levels above only the fourth is stored.
    assert nodes == [400, 4]
