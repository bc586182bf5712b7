"""Operators with SQL: the registered queries against it, their parts against brute force, odd input."""

import itertools
import math

import pytest
from edges import DOCS, clashing, empty, odd, rows
from license_texts import TEXTS
from oracle import compare
from pyspark.sql import functions as F

from tessella.llm import queries
from tessella.llm.licenses import RULES, SENTENCES, scan_licenses
from tessella.llm.lines import drop_recurring_lines
from tessella.llm.mixing import hashed_uniform, mix_sources, poisson_quantile
from tessella.llm.packing import optimal_bounds, pack


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01")


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or {}).get(i, "s"), len(t or "")) for i, t in enumerate(texts)], DOCS)


# licences

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice."""


def test_licences_are_named(spark):
    texts = [MIT, BSD, BSD + "\n3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products.", "Text.\nLicensed under CC BY-NC 4.0.", "A licence is a fine thing.", "nothing", "Released under the MIT License. Released under the MIT License."]
    got = {r.doc_id: (r.licenses, r.status) for r in scan_licenses(docs(spark, texts)).collect()}
    assert got == {0: ("MIT", "known"), 1: ("BSD-2-Clause", "known"), 2: ("BSD-3-Clause", "known"), 3: ("CC-BY-NC-4.0", "known"), 4: ("", "unknown"), 5: ("", "none"), 6: ("MIT", "known")}


def test_canonical_texts_are_known_whole(spark):
    cases = [(name, text) for name, texts in TEXTS.items() for text in texts]
    got = {r.doc_id: (r.licenses, r.n_left, r.status, r.sentence_ids) for r in scan_licenses(docs(spark, [t for _, t in cases])).collect()}
    for k, (name, _) in enumerate(cases):
        assert got[k][:3] == (name, 0, "known"), got[k]


def test_every_phrase_and_rule_is_reached(spark):
    """A sentence made of each phrase has its identifier, and each sequence of first phrases has its licence."""
    filled = {}
    for key, phrase in SENTENCES:
        filled.setdefault(key, []).append(phrase.strip("=").replace("%", "17" if phrase.endswith("%") else "some people"))
    single = [(key, f"{p.capitalize()}.") for key, phrases in filled.items() for p in phrases]
    whole = [(name, ids, "\n\n".join(filled[x][0] for x in ids)) for name, ids in RULES]
    got = {r.doc_id: r for r in scan_licenses(docs(spark, [t for _, t in single] + [t for _, _, t in whole])).collect()}
    for k, (key, text) in enumerate(single):
        assert key in got[k].sentence_ids.split(">"), (key, text, got[k])
    for k, (name, ids, _) in enumerate(whole, len(single)):
        assert name in got[k].licenses.split(",") and got[k].n_left == 0, (name, ids, got[k])


def test_tags_versions_and_dual_licences(spark):
    texts = ["SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: Apache-2.0 OR MIT\ncode", "Licensed under either of the Apache License, Version 2.0 or the MIT license, at your option.", "under the terms of the GNU Lesser General Public License version 3", "This work is under CC0 1.0.", "Unauthorized copying of this file, via any medium is strictly prohibited.", "See the GNU General Public License for more details."]
    got = [(r.licenses, r.status) for r in scan_licenses(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [("MIT", "known"), ("Apache-2.0,MIT", "known"), ("Apache-2.0,MIT", "known"), ("LGPL-3.0", "known"), ("CC0-1.0", "known"), ("Proprietary", "known"), ("", "unknown")]


def test_licence_scan_of_odd_input(spark):
    got = rows(scan_licenses(odd(spark)))
    assert len(got) == 13 and {r[4] for r in got if r[0] in (1, 2, 3)} == {"none"}
    assert rows(scan_licenses(clashing(spark))) == got and scan_licenses(empty(spark)).count() == 0


# mixing


def quantile(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_poisson_quantile(spark):
    rates, us = [0.01, 0.5, 1.0, 3.3, 40.0], [0.0, 0.1, 0.37, 0.5, 0.9, 0.999, 0.9999999]
    df = spark.createDataFrame([(r, u) for r in rates for u in us], "r double, u double")
    for row in df.select("r", "u", poisson_quantile(F.col("u"), F.col("r")).alias("k")).collect():
        assert row.k == quantile(row.u, row.r), row
    big = spark.range(400).select(poisson_quantile(hashed_uniform(F.lit(1), F.col("id")), F.lit(2000.0)).alias("k")).agg(F.avg("k"), F.stddev("k")).first()
    assert abs(big[0] - 2000) < 10 and abs(big[1] - math.sqrt(2000)) < 6
    assert spark.range(1).select(poisson_quantile(F.lit(0.5), F.lit(0.0)), poisson_quantile(F.lit(0.5), F.lit(None).cast("double"))).first() == (0, 0)


def test_mixture_reaches_its_weights(spark):
    texts = ["abcdefghij"] * 3000
    df = docs(spark, texts, {i: "big" if i < 2400 else "small" for i in range(3000)})
    got = {r[0]: r[1] for r in mix_sources(df, {"big": 1, "small": 3}).groupBy("source").count().collect()}
    assert abs(got["big"] / 750 - 1) < 0.15 and abs(got["small"] / 2250 - 1) < 0.15
    assert rows(mix_sources(df, broadcast_rows=0)) == rows(mix_sources(df))
    shuffled = [r.doc_id for r in mix_sources(df).collect()]
    assert shuffled != sorted(shuffled)


def test_mixing_odd_input(spark):
    got = mix_sources(odd(spark), epochs=5.0)
    assert got.columns[-3:] == ["n_copies", "copy", "shuffle_key"]
    assert None in {r.source for r in got.collect()}
    slim = lambda df: rows(df.select("doc_id", "text", "n_copies", "copy", "shuffle_key"))
    assert slim(mix_sources(clashing(spark), epochs=5.0)) == slim(got)
    assert mix_sources(empty(spark)).count() == 0 and mix_sources(odd(spark), {}).count() == 0
    assert {r.source for r in mix_sources(odd(spark), {"b": 1.0, "nowhere": 2.0}, epochs=50.0).collect()} == {"b"}


# packing


def padding(hist, bounds):
    return sum(n * (next(b for b in bounds if b >= x) - x) for x, n in hist)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_optimal(seed):
    import random

    rng = random.Random(seed)
    hist = [(x, rng.randrange(1, 50)) for x in sorted(rng.sample(range(200), 11))]
    for k in (1, 2, 3, 5):
        lengths = [x for x, _ in hist]
        best = min(padding(hist, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], k - 1))
        got = optimal_bounds(hist, k)
        assert len(got) <= k and padding(hist, got) == best


def test_batches_keep_their_budget_and_are_full(spark):
    df = docs(spark, ["w " * (i % 37) for i in range(900)])
    got = pack(df, buckets=4, budget=100, slice_rows=50).collect()
    assert len(got) == 900
    batches = {}
    for r in got:
        assert r.n_tokens <= r.padded_to
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), inside in batches.items():
        assert len(inside) * inside[0].padded_to <= 100
        assert sorted(r.slot for r in inside) == list(range(len(inside)))
        if (bucket, batch + 1) in batches:
            assert len(inside) == 100 // inside[0].padded_to


def test_long_documents_are_in_the_same_program(spark):
    """A document of any length takes part in the choice of bounds: lengths around 65,536 share a bucket if that pads less."""
    sizes = [65_530, 65_540, 70_000, 3, 4]
    got = pack(docs(spark, ["w " * n for n in sizes]), buckets=3).collect()
    assert {r.n_tokens: r.padded_to for r in got} == {65_530: 65_540, 65_540: 65_540, 70_000: 70_000, 3: 4, 4: 4}


def test_batches_do_not_depend_on_partitions(spark):
    df = docs(spark, ["w " * (i % 37) for i in range(900)])
    slim = lambda df: rows(df.select("doc_id", "bucket", "batch", "slot"))
    assert slim(pack(df, budget=100, parts=1)) == slim(pack(df, budget=100, parts=50)) == slim(pack(df, budget=100, parts=50, broadcast_rows=0))


def test_packing_odd_input(spark):
    got = pack(odd(spark))
    assert got.count() == 13
    slim = lambda df: rows(df.select("doc_id", "text", "n_tokens", "bucket", "padded_to", "batch", "slot"))
    assert slim(pack(clashing(spark))) == slim(got)
    assert pack(empty(spark)).count() == 0
    long = pack(docs(spark, ["w " * 70_000, "w " * 70_000, "w"])).where("n_tokens = 70000").collect()
    assert sorted((r.batch, r.slot, r.padded_to) for r in long) == [(0, 0, 70_000), (1, 0, 70_000)]
    negative = pack(docs(spark, ["a", "b"]), length=F.lit(-3)).select("n_tokens").distinct().collect()
    assert [r[0] for r in negative] == [0]


# lines


def test_recurring_lines_go_from_all_places_but_the_first(spark):
    passage = "this passage of many words recurs in several documents of the corpus"
    texts = [f"own line number zero here\n{passage}", f"{passage}\nanother line that is alone", f"x\n\n{passage}\n{passage}", None, "page 3 of 17 in all", "page 4 of 17 in all"]
    got = {r.doc_id: (r.text, r.n_dropped) for r in drop_recurring_lines(docs(spark, texts)).collect()}
    assert got[0] == (texts[0], 0)
    assert got[1] == ("another line that is alone", 1)
    assert got[2] == ("x\n", 2)
    assert got[3] == (None, 0) and got[4] == (texts[4], 0) and got[5] == ("", 1)


def test_variable_fields_join_a_template_and_other_lines_do_not(spark):
    texts = ["user alice logged in from the office today at noon", "user alice logged in from the office today at night", "user alice wants other things and says so very often here", "user alice logged in from the office today at noon now"]
    got = {r.doc_id: r.n_dropped for r in drop_recurring_lines(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}


def test_every_template_of_a_leaf_is_found(spark):
    """One leaf, many one-off lines before the templates, four templates of three documents each, one or two fields that differ."""
    other = [f"in the end {a} went over {b} fields {a}ly on" for a, b in zip("amber birch cedar dusk ember".split(), "far near wide long old".split(), strict=True)]
    frames = ["in the end {} was seen near the old {}", "in the end {} paid more for bread and {}", "in the end all of us met {} and {}", "in the end nobody had {} but a {}"]
    fields = [("Kim", "mill"), ("Lou", "mill"), ("Kim", "pond")]
    texts = [*other, *(f.format(*x) for x in fields for f in frames)]
    got = {r.doc_id: r.n_dropped for r in drop_recurring_lines(docs(spark, texts)).collect()}
    assert got == {i: int(i >= len(other) + len(frames)) for i in range(len(texts))}


def test_short_lines_and_lines_of_numbers(spark):
    texts = ["Read more\n12 14\nThe end of one", "Read more\n12 14\nAn end of two", "Menu\nnothing like it", "Menu\nit is like nothing"]
    got = {r.doc_id: r.text for r in drop_recurring_lines(docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "12 14\nAn end of two", 2: texts[2], 3: "it is like nothing"}


def test_a_line_repeated_in_one_document_stays(spark):
    text = "the same line over and over\nthe same line over and over"
    assert drop_recurring_lines(docs(spark, [text])).first().text == text


def test_lines_of_odd_input(spark):
    got = drop_recurring_lines(odd(spark))
    assert got.count() == 13
    slim = lambda df: rows(df.select("doc_id", "text", "n_chars", "n_lines", "n_dropped"))
    assert slim(drop_recurring_lines(clashing(spark))) == slim(got)
    assert slim(drop_recurring_lines(odd(spark), broadcast_rows=0)) == slim(got)
    by = {r.doc_id: r for r in got.collect()}
    assert by[6].text and by[7].text == "" and by[1].text is None and by[9].n_dropped == 0
    assert drop_recurring_lines(empty(spark)).count() == 0
