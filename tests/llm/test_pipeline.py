import random

from brute import DOCS, as_kept, docs_frame

import __spark_entry__ as entry
import corpus_pipeline as pipeline


def test_stages_and_registration():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "packing"]
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert not [n for n in entry.oracle_sql() if n not in names]


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeinrstlo") for _ in range(rng.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    item, passage = line(30), line(20)
    texts = [line(rng.randint(30, 80)) for _ in range(300)]
    for i in range(0, 300, 10):
        texts[i] = texts[i].upper().replace(" ", "!! ")
    texts[41], texts[52], texts[63], texts[64] = texts[31], f"{texts[52]} {item}", f"{texts[63]} {passage}", f"{texts[64]} {passage}"
    texts += [None, ""]
    docs = docs_frame(spark, texts)
    spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept.append(docs)
    left = [{r["doc_id"]: r["text"] for r in d.collect()} for d in kept[:4]]
    assert all(d.columns == DOCS.names and [t for _, t in d.dtypes] == [f.dataType.simpleString() for f in DOCS] for d in kept[:4])
    good = {i for i in range(300) if i % 10}
    assert good - set(left[0]) == set() and len(set(left[0]) & {i for i in range(300) if not i % 10}) <= 1
    assert 41 in left[0] and set(left[0]) - set(left[1]) >= {41} and len(set(left[0]) - set(left[1])) <= 2
    assert left[2] == as_kept(left[1])
    assert passage[5:].strip() in left[2][63] and passage[5:-5] not in left[2][64]
    assert set(left[2]) - set(left[3]) == {52}
    packed = kept[4].collect()
    assert {r["doc_id"] for r in packed} == set(left[3])
    whole = pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_rows_of_repeated_and_null_doc_ids(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeinrstlo") for _ in range(rng.randint(3, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    a, b, c, d, e, f, passage, item = (line(60) for _ in range(8))
    rows = [(3, b), (5, b), (5, a), (3, b), (3, b), (7, d), (7, d), (7, f"{e} {item}"), (None, c), (None, c), (None, d), (None, f"{f} {passage}"), (None, f"{item} {f[:90]}"), (2**60 + 1, passage)]
    docs = docs_frame(spark, [t for _, t in rows], [i for i, _ in rows])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    taken = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=order)
    near = pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    kept = [(3, b), (5, a), (7, d), (7, f"{e} {item}"), (2**60 + 1, passage), (None, c), (None, f"{f} {passage}"), (None, f"{item} {f[:90]}")]
    assert taken(near) == sorted(kept, key=order) and near.columns == DOCS.names
    left = pipeline.leak_stage(spark, near, str(tmp_path))
    clean = [x for x in kept if item not in x[1]]
    assert taken(left) == sorted(clean, key=order) and (7, d) in clean
    # A row without doc_id comes after the others, so it loses the passage; all rows stay.
    cut = pipeline.suffix_stage(spark, left, str(tmp_path))
    assert taken(cut) == sorted([(i, f"{f} " if t == f"{f} {passage}" else t) for i, t in clean], key=order)
    assert cut.columns == DOCS.names and [t for _, t in cut.dtypes] == [x.dataType.simpleString() for x in DOCS]
    # Exact repeats are emptied but for one.
    again = pipeline.suffix_stage(spark, docs_frame(spark, [a, a, a], [4, 4, None]), str(tmp_path))
    assert sorted(r["text"] for r in again.collect()) == ["", "", a]
    assert {r["doc_id"] for r in pipeline.packing_stage(spark, cut, str(tmp_path)).collect()} == {3, 5, 7, 2**60 + 1, None}
