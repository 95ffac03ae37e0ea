import random

from brute import docs_frame

from marquee.llm import licences, tiling

MIT = "The above copyright notice and this permission notice shall be\nincluded in all copies or substantial portions of the Software."
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_rules(spark):
    texts = ["Some text.\nReleased under the MIT License.\nMore.", "x. Licensed under CC BY-NC 4.0. All rights reserved.", MIT, GPL, "License", None, "", "a licence for dogs. " * 400, "ALL RIGHTS RESERVED!"]
    df = docs_frame(spark, texts, extra=("rule", "licence", "_t"))
    got = {}
    for r in licences.scan(df).collect():
        got.setdefault(r["doc_id"], set()).add(r["licence"])
    assert {k: sorted(v) for k, v in got.items()} == {0: ["MIT"], 1: ["CC-BY-NC-4.0", "Proprietary"], 2: ["MIT"], 8: ["Proprietary"], 3: ["GPL-3.0"]}


def test_order_of_sentences_decides(spark):
    source = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    df = docs_frame(spark, [f"{source}\n{binary}", f"{binary}\n{source}", f"{source} Word. {binary}"])
    assert sorted(r["doc_id"] for r in licences.scan(df).collect()) == [0, 2]


def test_every_known_sentence_passes_the_gate():
    assert all(any(a in s for a in licences.ANCHORS) for s in licences.SENTENCES)
    assert {i for _, ids in licences.RULES for i in ids} <= set(licences.SENTENCES.values())


def test_wrapped_and_spaced_sentences_pass_the_gate(spark):
    texts = ["(c) X. All rights\nreserved.", "(c) X. All rights  reserved.", "All rights\treserved", "all rights-reserved", "Word. All Rights\r\nReserved!", "This is free and unencumbered software released into the public\ndomain.", "This is free and unencumbered software released into the public  domain.", "A reserved seat in the domain."]
    got = sorted((r["doc_id"], r["licence"]) for r in licences.scan(docs_frame(spark, texts)).collect())
    assert got == [(i, "Proprietary") for i in range(5)] + [(5, "Unlicense"), (6, "Unlicense")]


def test_anchors_are_parts_of_single_words():
    assert all(any(a in word for a in licences.ANCHORS for word in s.split()) for s in licences.SENTENCES)
    assert all(a.isalnum() for a in licences.ANCHORS)


def test_licences_of_repeats_and_nothing(spark):
    df = docs_frame(spark, ["All rights reserved."] * 3, [1, 1, None])
    assert licences.scan(df).count() == 3 and licences.scan(docs_frame(spark, [])).count() == 0


def plain_tiles(item, text, least):
    """Longest common unmarked run again and again."""
    a, b, total = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return total
        a[i : i + k] = [True] * k
        b[j : j + k] = [True] * k
        total += k


def test_tiles_against_the_plain_rule():
    rng = random.Random(9)
    for _ in range(150):
        item = [rng.randrange(4) for _ in range(rng.randint(0, 30))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5 and item:
            k = rng.randrange(len(item))
            text = text[:5] + item[k:] + [9] + item[:k] + text[5:]
        found = tiling.tiles(item, text, 3)
        for i, j, k in found:
            assert item[i : i + k] == text[j : j + k] and k >= 3
        assert len({x for i, _, k in found for x in range(i, i + k)}) == sum(k for *_, k in found)
        assert max((k for *_, k in found), default=0) == max((k for *_, k in tiling.tiles(item, text, 3, 100)), default=0)
        rest = plain_tiles(item, text, 3)
        assert abs(sum(k for *_, k in found) - rest) <= 3  # ties may tile otherwise


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [" ".join(word() for _ in range(24)) for _ in range(6)]
    noise = lambda n: " ".join(word() for _ in range(n))
    half = lambda t: " ".join(t.split()[12:] + ["then"] + t.split()[:12])
    texts = [noise(200), noise(50) + " " + items[0] + " " + noise(30), half(items[1]), items[2].upper().replace(" ", ", "), " ".join(items[3].split()[:7]), None, "", items[4] + " " + items[5], noise(20_000) + " " + items[0]]
    df = docs_frame(spark, texts, extra=("row", "item", "seed", "words"))
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "too few words"), (None, items[0])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["covered"], r["item_words"]) for r in tiling.covered(df, bench).collect()}
    assert got == {(1, 0): (24, 24), (1, None): (24, 24), (2, 1): (24, 24), (3, 2): (24, 24), (7, 4): (24, 24), (7, 5): (24, 24), (8, 0): (24, 24), (8, None): (24, 24)}
    assert (4, 3) in {(r["doc_id"], r["item_id"]) for r in tiling.covered(df, bench, threshold=0.25).collect()}


def test_a_long_run_of_a_longer_item_leaks(spark):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = ["x " + " ".join(words[20:33]) + " y", "x " + " ".join(words[20:32]) + " y"]
    assert [(r["doc_id"], r["longest"]) for r in tiling.covered(docs_frame(spark, texts), bench).collect()] == [(0, 13)]


def test_leaks_of_repeats_and_nothing(spark):
    text = "one two three four five six"
    bench = spark.createDataFrame([(1, text), (1, text)], "item_id long, text string")
    assert tiling.covered(docs_frame(spark, [text, text, text], [3, 3, None]), bench).count() == 6
    assert tiling.covered(docs_frame(spark, []), bench).count() == 0
    assert tiling.covered(docs_frame(spark, [text]), spark.createDataFrame([], "item_id long, text string")).count() == 0
