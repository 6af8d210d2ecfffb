import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradewalk.llm import fill_in_middle as fim
from gradewalk.llm import filter_audit, reply_trees


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11: filter interaction audit ----


def audited(rows, letters, lost):
    """Every order walked row by row."""
    out, parts = {}, {r[0] for r in rows}
    for part in parts:
        mine = [r for r in rows if r[0] == part]
        for order in permutations(letters):
            gone = set()
            for step, x in enumerate(order, 1):
                failing = [i for i, (_, fails, _) in enumerate(mine) if x in fails]
                here = [i for i in failing if i not in gone]
                gone |= set(here)
                only = sum(mine[i][1] == {x} for i in failing)
                out[part, "".join(order), step] = (len(mine) - len(gone), len(here), len(failing) - len(here), only, *(sum(k in mine[i][2] for i in here) for k in lost))
    return out


@pytest.mark.parametrize("letters", ["A", "AB", "XYZ", "ABCD"])
def test_audit_by_walking_every_order(spark, letters):
    rng = random.Random(len(letters))
    rows = [(rng.choice("pq"), {x for x in letters if rng.random() < 0.4}, {k for k in ("g", "t") if rng.random() < 0.3}) for _ in range(90)]
    df = spark.createDataFrame([(p, *(x in f for x in letters), "g" in w, "t" in w) for p, f, w in rows], ", ".join(["p string", *(f"f_{x} boolean" for x in letters), "g boolean", "t boolean"]))
    got = filter_audit.audit(df, {x: f"f_{x}" for x in letters}, "p", {"good_lost": "g", "toxic_lost": "t"}).collect()
    want = audited(rows, letters, ("g", "t"))
    assert len(got) == len(want)
    shares = Counter()
    for r in got:
        key = r["part"], r["filter_order"], r["step"]
        assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]) == want[key][:6]
        shares[r["part"], r["filter_order"][r["step"] - 1]] += r["removed"]
    assert all(r["shapley"] == shares[r["part"], r["filter_order"][r["step"] - 1]] for r in got)
    # each row that fails k filters counts one k-th for each of them
    exact = sum(Fraction(1, len(f)) for p, f, _ in rows if p == "p" and letters[0] in f) * len(list(permutations(letters)))
    assert exact == shares["p", letters[0]]


def test_audit_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit_documents(odd_documents, labels).collect()
    assert Counter(r["part"] for r in got) == dict.fromkeys(("en", "de", "fr", ""), 600)
    en = {r["filter_order"][0]: r for r in got if r["part"] == "en" and r["step"] == 1}
    # English rows: the fox twice, a null text (the same as the empty one of id 3, which is larger), symbols, a very long one and capitals
    assert {x: r["removed"] for x, r in en.items()} == {"A": 5, "B": 1, "C": 1, "D": 1, "E": 0}
    assert (en["A"]["good_lost"], en["A"]["toxic_lost"]) == (2, 2)
    assert next(r["removed"] for r in got if r["part"] == "" and r["filter_order"][0] == "E" and r["step"] == 1) == 1
    assert filter_audit.audit_documents(no_documents, labels).count() == 0
    assert filter_audit.audit_documents(odd_documents, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
    with pytest.raises(ValueError):
        filter_audit.audit(labels, {"AB": "quality"}, "doc_id", {})


def test_repeats_by_hand(spark):
    rows = [(3, "x"), (1, "x"), (1, "x"), (2, "y"), (None, "x"), (5, "z"), (5, "z"), (9, "x")]
    got = filter_audit.with_repeats(spark.createDataFrame(rows, "k long, d string"), "k", "d", "again").collect()
    assert Counter((r["k"], r["d"]) for r in got if r["again"]) == {(3, "x"): 1, (9, "x"): 1} and len(got) == len(rows)


# ---- 12: fill in the middle ----

SHAPES = {**fim.GRAMMARS, "digits": r"[0-9]*x|[0-9]+|[^0-9x]+"}
TEXTS = ["", "\n", "\n\n", "a", "a\n", "\na", "one\ntwo\n\nthree", "x y  z ", "12x34 5x", "Ab_1 += 2;\n\tnext", "🙂é\n日本 🙂🙂", "A. B? C!D", "\r\n\r\n", "x" * 5000 + "\n" + "y z " * 5000]


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_boundaries_cut_as_the_grammar_matches(spark, name):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab1x9 \n\t.!_é🙂") for _ in range(rng.randrange(30))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["u"] for r in df.select("i", fim.units(F.col("t"), SHAPES[name]).alias("u")).collect()}
    assert got == {i: re.findall(SHAPES[name], t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("bad", ["", "(a)", "[a]*[b]+", "a{2}", "[a", "a||b"])
def test_other_expressions_are_no_grammars(bad):
    with pytest.raises(ValueError):
        fim.boundary(bad)


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("<P>", "<P>x", "c"), ("xay", "a", "c")])
def test_markers_that_could_arise_are_refused(bad):
    with pytest.raises(ValueError):
        fim.Markers(*bad)


def rearranged(key, text, rate=100, spm_rate=50, marks=("<P>", "<S>", "<M>")):
    us = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    h = [int(sha(f"7:{'' if key is None else key}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(us) + 1), h[1] % (len(us) + 1)))
    pre, mid, suf = "".join(us[:a]), "".join(us[a:b]), "".join(us[b:])
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(us), "plain", None, None, text or ""
    p, s, m = marks
    if h[3] % 100 < spm_rate:
        return len(us), "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return len(us), "psm", len(pre), len(mid), p + pre + s + suf + m + mid


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 100), (100, 0)])
def test_rearranged_by_hand_and_restored(spark, rate, spm_rate):
    rng = random.Random(8)
    texts = TEXTS + [None, "a <P> b\nc", "<S>", "x<M", "<\n<P\n<S<\nM>"] + ["".join(rng.choice("ab<PSM>\n🙂") for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame([*enumerate(texts), (None, "one\ntwo\nthree\n"), (3, texts[3])], "doc_id long, text string")
    made = fim.fill_in_middle(df, rate=rate, spm_rate=spm_rate)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(texts) + 2 and {r["form"] for r in got} >= {"plain", "spm" if spm_rate else "psm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == rearranged(r["doc_id"], r["text"], rate, spm_rate)
        assert r["back"] == (r["text"] or "")


def test_middles_of_odd_rows(odd_documents, no_documents):
    clashing = odd_documents.withColumns({"form": F.lit("x"), "_text": F.lit("y"), "_units": F.lit("z"), "output": F.lit("u"), "_row": F.lit("v")})
    rows = fim.fill_in_middle(clashing).collect()
    assert len(rows) == 10 and all((r["_text"], r["_units"], r["_row"]) == ("y", "z", "v") and r["form"] != "x" for r in rows)
    report = fim.middle_report(odd_documents).collect()
    assert Counter((r["doc_id"], r["restored_sha256"]) for r in report) == Counter((r["doc_id"], sha(r["text"] or "")) for r in rows)
    assert fim.middle_report(no_documents).count() == 0


# ---- 13: chat formatting ----


def paths_by_hand(messages):
    """Root-to-leaf paths of one tree of (id, parent, score), best first."""
    by_id = {m[0]: m for m in messages}
    answered = {m[1] for m in messages}
    out = []
    for i in by_id:
        path, at = [], i
        while at in by_id and at not in path:
            path.append(at)
            at = by_id[at][1]
        if i not in answered and at not in path:
            out.append((-sum(by_id[x][2] or 0 for x in path) / len(path), -len(path), i, path[::-1]))
    return [(i, path) for *_, i, path in sorted(out)]


def test_branches_by_hand(spark):
    rng = random.Random(12)
    trees = {t: [(i, None if i == 0 or rng.random() < 0.03 else rng.randrange(max(0, i - 4), i), rng.choice([None, 0.25, 0.5, 1.0])) for i in range(rng.randrange(1, 60))] for t in range(8)}
    trees[9] = [(i, i - 1 if i else None, 0.0) for i in range(70)]  # a chain
    trees[10] = [(0, None, 0.0), (1, 2, 0.0), (2, 1, 0.0), (3, 1, 0.0), (4, 4, 0.0)]  # circles beside a root
    trees[11] = [(5, 99, 1.0), (6, 5, 1.0)]  # a parent that isn't there
    rows = [(t, i, p, rng.choice(["user", "assistant", "system"]), f"<{t}.{i}>", s) for t, ms in trees.items() for i, p, s in ms]
    df = spark.createDataFrame(rows, "conv_id long, message_id long, parent_id long, role string, text string, score double").repartition(3)
    text = {(t, i): (role, said) for t, i, _, role, said, _ in rows}
    for best in (1, 3, 1000):
        got = {(r["conv_id"], r["rank"]): r for r in reply_trees.format_trees(df, best=best).collect()}
        want = {(t, n): x for t, ms in trees.items() for n, x in enumerate(paths_by_hand(ms)[:best], 1)}
        assert {k: r["leaf_id"] for k, r in got.items()} == {k: leaf for k, (leaf, _) in want.items()}
        for (t, n), (_, path) in want.items():
            turns = [text[t, i] for i in path]
            r = got[t, n]
            assert r["conversation"] == "".join(f"<s>{role}[INST]{said}</s>" for role, said in turns)
            assert [r["conversation"][x["start"] : x["stop"]] for x in r["turns"]] == [f"<s>{role}[INST]{said}</s>" for role, said in turns]
            assert [r["conversation"][x["loss_start"] : x["loss_stop"]] for x in r["turns"] if x["loss_start"] is not None] == [said for role, said in turns if role == "assistant"]


ODD = st.text(alphabet=st.sampled_from(list("<[]/s>INST\\ é🙂\n")), max_size=24) | st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\\\INST]", "x"]), max_size=6).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), min_size=1, max_size=40))
def test_escaping_is_exact(spark, turns):
    rows = [(0, i, role, said) for i, (role, said) in enumerate(turns)] + [(1, i, "assistant", said) for i, (_, said) in enumerate(turns)]
    formatted = reply_trees.format_trees(reply_trees.as_chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    said, learned = reply_trees.read_back(F.col("conversation"), F.col("turns"))
    got = {r["conv_id"]: r for r in formatted.select("conv_id", said.alias("said"), learned.alias("learned")).collect()}
    assert [tuple(x) for x in got[0]["said"]] == turns
    assert list(got[1]["learned"]) == [t for _, t in turns]


@pytest.mark.parametrize("bad", [{"start": "<"}, {"stop": "[INST][INST]"}, {"says": "x\\y"}, {"start": ""}])
def test_templates_that_overlap_are_refused(bad):
    with pytest.raises(ValueError):
        reply_trees.Template(**bad)


def test_chats_of_odd_rows(spark):
    rows = [(1, 1, "user", "b"), (1, 0, None, "a"), (1, 1, "user", "b"), (1, None, "system", None), (None, 5, "assistant", "x"), (None, 4, None, None), (2, -5000, "user", ""), (2, 7000, "assistant", "long " * 5000), (2, 1030, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "conv_id long, turn long, role string, text string, tree string, score int")
    got = {r["conv_id"]: r for r in reply_trees.chat_report(df).collect()}
    assert set(got) == {1, None, 2, -7}
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == sha("system\n\n" + "\na\n" + "user\nb\n" * 2) and got[1]["loss_chars"] == 0
    assert got[None]["turns_sha256"] == sha("\n\nassistant\nx\n") and got[None]["loss_sha256"] == sha("x")
    assert got[2]["turns_sha256"] == sha("user\n\nassistant\n\nassistant\n" + "long " * 5000 + "\n") and got[2]["loss_chars"] == 25_000
    said = "</s>[INST] ok [/INST]"
    assert got[-7]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and got[-7]["loss_sha256"] == sha(said) and got[-7]["formatted_chars"] == 2 * (13 + len(said) + 3) + 4 + 9
    assert [r["conv_id"] for r in reply_trees.chat_report(df.limit(0)).collect()] == [-7]


def test_positions_over_ranges(spark):
    rng = random.Random(1)
    rows = [(t, rng.randrange(-40, 40), i) for t in "ab" for i in range(120)]
    got = reply_trees.with_positions(spark.createDataFrame(rows, "t string, n long, i long"), "t", "n", ["i"], a_range=7).collect()
    want = {r: k for t in "ab" for k, r in enumerate(sorted(x for x in rows if x[0] == t))}
    assert {(r["t"], r["n"], r["i"]): r["_pos"] for r in got} == want
