"""Chat windows, mixing and licences."""

import collections
import hashlib
import random
import re
import textwrap
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from vlprep.llm import chat, licences, mixing

TURNS = "conv_id long, turn long, role string, text string"


def said(rows):
    """Per conversation: turns, their digest, loss characters and digest, straight from the rows."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations(seed=3):
    rng = random.Random(seed)
    odd = ["\\### Assistant: </turn> ok", "&lt;", "&amp;lt; <turn new user>", "</turn>\n", "", None, "é😀 <", "\\", "&"]
    rows = []
    for conv in range(40):
        start = rng.choice(["system", "user", None])
        for turn in range(rng.choice([1, 2, 7, 60])):
            role = start if turn == 0 else rng.choice(["user", "assistant", "assistant", "system", "a>b<&"])
            rows.append((conv, turn * rng.choice([1, 1, 100]), role, rng.choice(odd + ["word " * rng.choice([1, 20, 300])] * 6)))
    return rows + [(100, None, "user", "x"), (100, 1, "assistant", "y"), (100, 1, "assistant", "y"), (None, 0, "system", "s"), (None, 1, "assistant", "t")]


@pytest.mark.parametrize("budget,history", [(1024, 256), (120, 40), (60, 0), (10, 30)])
def test_windows_give_all_turns_back(spark, budget, history):
    rows = conversations()
    formatted = chat.windows(spark.createDataFrame(rows, TURNS).repartition(5), budget, history).cache()
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(formatted).collect()}
    assert got == said(rows)


def test_windows_keep_the_budget(spark):
    rows = conversations(5)
    budget, history = 150, 50
    found = chat.read_turns(chat.windows(spark.createDataFrame(rows, TURNS), budget, history)).collect()
    cost = lambda t: -(-len(t) // 4) + 4
    opening = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        opening.setdefault(conv, (role, text or ""))
    for w in found:
        new = [t for t in w["turns"]]
        if w["over_budget"]:
            own = sum(cost(t["text"]) for t in new if t["role"] != "system" or len(new) == 1)
            assert max(cost(t["text"]) for t in new) > budget - history - 60 or cost(opening[w["conv_id"]][1]) > history or own > budget - history
        else:
            assert w["n_tokens"] <= budget
        if opening[w["conv_id"]][0] == "system":
            body = chat_escape(opening[w["conv_id"]][1])
            assert w["text"].startswith((f"<turn new system>{body}</turn>", f"<turn old system>{body}</turn>"))
    firsts = [w for w in found if w["window"] == min(x["window"] for x in found if x["conv_id"] == w["conv_id"])]
    assert not any("<turn old" in w["text"] for w in firsts)
    assert any("<turn old assistant>" in w["text"] for w in found)


def test_tokens_of_the_users_own(spark):
    """A function that gives no tokens for some turns loses and disorders nothing."""
    rows = conversations(8)
    formatted = chat.windows(spark.createDataFrame(rows, TURNS).repartition(5), 40, 10, lambda t: F.when(F.length(t) > 30, F.length(t)).when(F.length(t) > 3, F.lit(0)))
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(formatted).collect()} == said(rows)


def test_no_join_or_window_by_conversation_alone(spark):
    """But for sums over groups of groups, nothing is dealt out by ``conv_id`` alone."""
    found = chat.windows(spark.createDataFrame(conversations(), TURNS).repartition(5))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan
    dealt = re.findall(r"hashpartitioning\((.*), \d+\), ", plan)
    assert dealt and all(re.search(r"_group|_of|window|_super|_bin|_in", d) for d in dealt)


def chat_escape(text):
    return text.replace("&", "&amp;").replace("<", "&lt;")


def test_escaping_is_undone(spark):
    rows = [(t,) for t in ["", "&", "&lt;", "&amp;lt;", "<>&<", "</turn>\n", "\\l"]]
    t = spark.createDataFrame(rows, "t string")
    for there, back in ((chat.escape, chat.unescape), (chat.escape_role, chat.unescape_role)):
        got = t.select("t", there(F.col("t")).alias("e")).withColumn("b", back(F.col("e"))).collect()
        assert all(r["t"] == r["b"] and "<" not in r["e"] for r in got)


def test_empty_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat.digests(chat.windows(none)).collect() == []
    extra = spark.createDataFrame([(1, 0, "user", "a", 5, 6)], TURNS + ", window long, pos long")
    assert chat.digests(chat.windows(extra)).first()["n_turns"] == 1


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(5000)]
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.windows(spark.createDataFrame(rows, TURNS))).collect()} == said(rows)


def worst_lag(order, blocks, weights):
    """Most that any source is off what it is due, at any slot; what is due follows from the weights alone."""
    done, worst = collections.Counter(), 0
    due = dict.fromkeys(blocks, Fraction(0))
    for s in order:
        done[s] += 1
        left = Fraction(1)
        while left:  # a source may run out within a slot
            active = {x: weights[x] for x in blocks if due[x] < blocks[x]}
            total = sum(active.values())
            step = min([left, *((blocks[x] - due[x]) * total / w for x, w in active.items())])
            for x, w in active.items():
                due[x] += step * w / total
            left -= step
        worst = max(worst, max(abs(done[x] - due[x]) for x in blocks))
    return worst


@pytest.mark.parametrize("seed", [0, 1, 2, 4, 5, 7, 9])
def test_schedule_deviates_by_less_than_a_block_from_end_to_end(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range([1, 2, 3, 5, 8, 12, 20, 20, 20, 30][seed])]
    blocks = {s: rng.choice([1, 2, 5, 17, 60, rng.randint(1, 120)]) for s in names}
    shares = {s: rng.choice([0.01, 0.5, 1, 1, rng.random(), n**0.5]) for s, n in blocks.items()}
    weights = mixing.whole_weights(shares)
    frame = rng.choice([3, 8, 16, 64])
    rows = sorted((r["slot"], r["source"], r["block"]) for r in mixing.schedule(spark, blocks, weights, frame).collect())
    assert [r[0] for r in rows] == list(range(sum(blocks.values())))
    assert sorted((s, k) for _, s, k in rows) == sorted((s, k) for s, n in blocks.items() for k in range(n))
    for s in names:  # blocks of a source come in their order
        assert [k for _, x, k in rows if x == s] == list(range(blocks[s]))
    assert worst_lag([s for _, s, _ in rows], blocks, weights) < 1


def test_whole_weights_keep_the_ratios():
    weights = mixing.whole_weights({"a": 1e-20, "b": 1 / 3, "c": 2 / 3, "d": 0, "e": -1})
    assert weights["a"] == 1 and weights["d"] == weights["e"] == 0
    assert abs(weights["b"] / weights["c"] - 0.5) < 1e-14 and abs(sum(weights.values()) - mixing.WHOLE) < 5


def test_schedule_is_made_in_tasks(spark):
    """What the plan holds of the schedule does not grow with the blocks."""
    sizes = []
    for n in (1_000, 1_000_000):
        blocks = {f"s{i}": n for i in range(5)}
        with pytest.MonkeyPatch.context() as m:
            seen = []
            m.setattr(mixing, "stored", lambda df, name: seen.append(len(df._jdf.queryExecution().logical().toString())) or df)
            mixing.schedule(spark, blocks, dict.fromkeys(blocks, 10**14))
        sizes.append(max(seen))
    assert sizes[1] < sizes[0] * 1.2


def test_rows_are_all_placed(spark, docs_of):
    rng = random.Random(2)
    rows = [(i, f"t{i}", None, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)] + [(5, "t5", None, "a")] * 3 + [(None, None, None, "d")]
    got = mixing.mix_sources(docs_of(rows), {"a": 0.5, "b": 0.3, None: 0.2}, block_rows=8).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    assert collections.Counter((r["doc_id"], r["source"]) for r in got) == collections.Counter((r[0], r[3]) for r in rows)
    order = [r["source"] for r in sorted(got, key=lambda r: r["slot"] * 8)]
    assert set(order[-2:]) <= {"a", "b", "c", "d", None}
    head = collections.Counter(r["source"] for r in got if r["position"] < 400)
    assert abs(head["a"] - 200) < 10 and abs(head["b"] - 120) < 10 and abs(head[None] - 80) < 10
    again = {r["doc_id"]: r["position"] for r in mixing.mix_sources(docs_of(rows, 7), {"a": 0.5, "b": 0.3, None: 0.2}, block_rows=8).collect() if r["doc_id"] not in (5, None)}
    assert again == {r["doc_id"]: r["position"] for r in got if r["doc_id"] not in (5, None)}


def test_mixing_odd_tables(spark, docs_of):
    assert mixing.mix_sources(docs_of([]).limit(0)).collect() == []
    clash = docs_of([(1, "a", None, "x"), (2, "b", None, "y")])
    for c in ("_source", "_at", "at", "bucket", "here", "rank", "start", "n", "c0"):
        clash = clash.withColumn(c, F.lit(f"mine {c}"))
    got = mixing.mix_sources(clash, {}).collect()
    assert sorted(r["position"] for r in got) == [0, 1]
    assert all(r[c] == f"mine {c}" for r in got for c in ("_source", "_at", "at", "bucket", "here", "rank", "start", "n", "c0"))
    with pytest.raises(ValueError, match="slot"):
        mixing.mix_sources(clash.withColumn("slot", F.lit(1)))


def test_licences(spark, docs_of):
    s = licences.SENTENCES
    rows = [
        (1, f"Some prose here. {s['apache-short']} More prose."),
        (2, f"{s['mit-grant']}\n\n{s['mit-notice']}\nUnknown words.\n{s['as-is'].lower()}"),
        (3, f"{s['mit-grant']}\n{s['as-is']}\n{s['mit-notice']}"),
        (4, f"{s['cc-by-4']} {s['reserved'].upper()}"),
        (5, None), (6, ""), (7, "word " * 100_000 + "." + "\n" + s["mit-short"]), (None, s["gpl3-short"]), (1, "All   rights -- reserved!"),
    ]
    got = sorted(((r["doc_id"], r["licences"]) for r in licences.scan(docs_of(rows)).collect()), key=str)
    want = [
        (1, ["Apache-2.0"]), (2, ["MIT"]), (3, []), (4, ["CC-BY-4.0", "all-rights-reserved"]), (5, []), (6, []), (7, ["MIT"]),
        (None, ["GPL-3.0-only"]), (1, ["all-rights-reserved"]),
    ]
    assert got == sorted(want, key=str)
    ids = {r["doc_id"]: r["sentence_ids"] for r in licences.scan(docs_of(rows)).collect()}
    assert ids[3] == ["mit-grant", "as-is", "mit-notice"]
    assert licences.scan(docs_of([]).limit(0)).collect() == []


def test_longer_rules_take_the_shorter_in(spark, docs_of):
    rules = {"long": [["mit-short", "reserved"]], "short": [["reserved"]], "other": [["mit-short"]]}
    text = f"{licences.SENTENCES['mit-short']}\n{licences.SENTENCES['reserved']}"
    assert licences.scan(docs_of([(1, text)]), rules=rules).first()["licences"] == ["long"]


MIT = '''MIT License

Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
'''
APACHE = '''Copyright 2024 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{}Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{}Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
BSD_NAME = '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''


def test_licences_as_they_stand_in_files(spark, docs_of):
    marked = lambda text, sign: "".join(f"{sign}{line}\n" for line in text.split("\n"))
    rows = [(0, MIT), (1, APACHE), (2, BSD.format("1. ", "2. ")), (3, BSD.format("(1) ", "b) ") + BSD_NAME), (4, BSD.format("* ", "* "))]
    signs = ["# ", "// ", " * ", "REM ", "dnl ", ";; "]
    rows += [(10 + i, marked(MIT, sign)) for i, sign in enumerate(signs)] + [(20 + i, marked(APACHE, sign).replace("\n", "\r\n")) for i, sign in enumerate(signs)]
    rows += [(30, "This is not licensed under the MIT License.")]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(docs_of(rows)).collect()}
    want = {0: ["MIT"], 1: ["Apache-2.0"], 2: ["BSD-2-Clause"], 3: ["BSD-3-Clause"], 4: ["BSD-2-Clause"], 30: []}
    assert got == want | {10 + i: ["MIT"] for i in range(6)} | {20 + i: ["Apache-2.0"] for i in range(6)}


@pytest.mark.parametrize("shares", [{"big": 10.0**0.5, **{f"s{i}": 1.0 for i in range(19)}}, {f"s{i}": 1 / i for i in range(1, 101)}, {"a": 0.5, "b": 0.3, "c": 1e-4}])
def test_schedule_keeps_the_given_shares(shares):
    blocks = dict.fromkeys(shares, 4000)
    order = [None] * sum(blocks.values())
    for p in mixing.plan(blocks, mixing.whole_weights(shares)):
        for k in range(p["blocks"]):
            order[p["start"] + k // p["weight"] * p["period"] + p["slots"][k % p["weight"]]] = p["source"]
    assert None not in order
    total, done, t = sum(shares.values()), dict.fromkeys(shares, 0), 0
    while max(done.values()) < 4000:
        done[order[t]] += 1
        t += 1
        if t % 50 == 0 or t < 50:
            assert max(abs(done[s] - t * v / total) for s, v in shares.items()) < 1 + 1e-9


def test_every_licence_is_found(spark, docs_of):
    """Each rule's sentences, as they stand in files: wrapped, in comments, and on a line of their own."""
    rows, want = [], {}
    for name, each in licences.RULES.items():
        for ids in each:
            text = "\n".join(licences.SENTENCES[i] for i in ids)
            lines = [line for i in ids for line in textwrap.wrap(licences.SENTENCES[i], 60)]
            for shown in (text, "\n".join(f" * {x}" for x in lines), "\n".join(f"# {x}" for x in lines) + "\n\nimport x"):
                rows.append((len(rows), shown))
                want[len(rows) - 1] = (ids, name)
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licences.scan(docs_of(rows)).collect()}
    assert {i: (s, names) for i, (s, names) in got.items()} == {i: (ids, [name]) for i, (ids, name) in want.items()}
