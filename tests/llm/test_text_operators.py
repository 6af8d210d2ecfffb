import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from gradewalk.llm import fingerprints, langid, minhash, packing, pitman_yor, secrets, sentencepiece_bpe, toxicity
from gradewalk.llm.words import find_words, text_chunks

PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


# ---- 1: SentencePiece ----


def test_encoding_equals_the_library(spark, odd_documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [prose(i, 40) for i in range(6)] + ["x" * 700, "日本語テキスト" * 40, "  a   b  ", "é" * 90, "foo▁bar baz", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (16_384, 64):  # whole, and in chunks with boundary states
        rows = sentencepiece_bpe.encode_documents(df, PIECES, size).orderBy("chunk").collect()
        ids = {i: sum((list(r["ids"]) for r in rows if r["doc_id"] == i), []) for i in range(len(texts))}
        assert ids == {i: library.encode(t) for i, t in enumerate(texts)}
        assert all(r["round_trip"] for r in rows)
    back = sentencepiece_bpe.decode_documents(sentencepiece_bpe.encode_documents(df, PIECES, 64), PIECES).orderBy("chunk").collect()
    assert {i: "".join(r["text"] for r in back if r["doc_id"] == i) for i in range(len(texts))} == {i: t.replace("▁", " ") for i, t in enumerate(texts)}


def test_boundary_states_of_many_chunks(spark):
    """The tree of products and the way back down give the path of greatest weight that a plain pass finds."""
    rng = random.Random(6)
    rows, want = [], {}
    for row, n in ((1, 300), (2, 1), (3, 7)):
        states = [["0|"], *([f"{k}|x" for k in range(3)] for _ in range(n - 1)), ["0|end"]]
        best = {"0|": (0, ["0|"])}
        for chunk in range(n):
            weight = {(e, x): rng.randrange(10**6) for e in states[chunk] for x in states[chunk + 1] if rng.random() < 0.8 or (e, x) == (states[chunk][0], states[chunk + 1][0])}
            rows += [(row, n, chunk, e, x, w) for (e, x), w in weight.items()]
            best = {x: max((best[e][0] + weight[e, x], [*best[e][1], x]) for e in best if (e, x) in weight) for x in states[chunk + 1] if any((e, x) in weight for e in best)}
        want[row] = best["0|end"][1]
    df = spark.createDataFrame(rows, "row long, n int, block int, e string, x string, weight long").repartition(3)
    got = sentencepiece_bpe.boundary_states(df, 300).collect()
    for row, path in want.items():
        assert [(r["e"], r["x"]) for r in sorted(got, key=lambda r: r["block"]) if r["row"] == row] == list(zip(path, path[1:], strict=False))


def test_known_stretches_are_not_gone_through(monkeypatch):
    """What is known is looked up: no call's work grows with the cache; a full cache keeps what is asked for."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = sentencepiece_bpe.Pieces(PIECES, most=12)
    monkeypatch.setattr(sentencepiece_bpe.Stretches, "__iter__", lambda self: pytest.fail("all known stretches were gone through"), raising=False)
    for i in range(4):
        text = prose(i, 30) + ", it's 3.5%!\nEnd"
        ids, good = model.encode([sentencepiece_bpe.SPACE + text.replace(" ", sentencepiece_bpe.SPACE)])[0]
        assert good and np.frombuffer(ids, "<i4").tolist() == library.encode(text)


def test_chunks_are_walked_together():
    """Chunks from places inside words, and from one that only spaces lead up to, between the states of the whole text's encoding."""
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_bpe.Pieces(PIECES)
    text, chunks, wanted = sentencepiece_bpe.SPACE + prose(3, 60).replace(" ", sentencepiece_bpe.SPACE) + sentencepiece_bpe.SPACE * 5 + "x" * 90, [], []
    pieces = [library.id_to_piece(i) for i in library.encode(text[1:])]
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    for size in (1, 7, 50):
        cuts = list(range(size, len(text), 31))
        for a, b in zip(cuts, cuts[1:], strict=False):
            i, j = (next(k for k, e in enumerate(ends) if e >= at) for at in (a, b))
            chunks.append((text[max(0, a - 16) : a], text[a:b], text[b : b + 16], (ends[i] - a, pieces[i]), (ends[j] - b, pieces[j])))
            wanted.append(([library.piece_to_id(p) for p in pieces[i + 1 : j + 1]], True))
    assert [(np.frombuffer(ids, "<i4").tolist(), good) for ids, good in sentencepiece_bpe.walk(model, chunks)] == wanted


def test_encoding_of_odd_rows(odd_documents, no_documents):
    rows = sentencepiece_bpe.encoding_report(odd_documents, PIECES).collect()
    assert len(rows) == 10 and all(r["round_trip"] for r in rows) and {r["n_ids"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert sentencepiece_bpe.encoding_report(no_documents, PIECES).count() == 0


# ---- 2: I-Match ----


def spark_hash(values):
    """xxhash64 of an array of longs: each value hashed with the hash so far as its seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64(int(v).to_bytes(8, "little", signed=True), seed=h).intdigest()
    return f"{h:016X}"


def marks_by_hand(text, df, n_docs, least_idf, most_idf):
    signed = lambda w: int(np.int64(np.uint64(xxhash.xxh64(w.encode(), seed=42).intdigest())))
    every = sorted({signed(w) for w in re.findall(r"[a-z0-9]+", text)})
    low, high = max(2, n_docs * math.exp(-most_idf)), max(2, n_docs * math.exp(-least_idf))
    band = sorted({signed(w) for w in re.findall(r"[a-z0-9]+", text) if low <= df.get(w, 0) <= high})
    levels = [band]
    for k in range(1, fingerprints.LEVELS):
        levels.append([t for t in levels[-1] if t >> 2 * k & 3 == 0])
    subsets = [[t for t in levels[k] if t >> (16 + 8 * k) & (fingerprints.SUBSETS - 1) == j] for k in range(fingerprints.LEVELS) for j in range(fingerprints.SUBSETS)]
    return [spark_hash(band) if band else "=" + spark_hash(every), *(spark_hash(x)[:8] if x else "-" for x in subsets)]


@pytest.mark.parametrize("rows_a_range", [64, 4])
def test_fingerprints_by_hand(spark, monkeypatch, rows_a_range):
    real = fingerprints.with_next
    monkeypatch.setattr(fingerprints, "with_next", lambda df, column: real(df, column, rows_a_range))
    texts = {i * i * i: prose(i % 17, 30 + i) for i in range(40)} | {1 << 62: "lonely words here", -(1 << 62): "nothing shared", 70000: ""}
    idf = (math.log(1.2), math.log(10))
    rows = {r["doc_id"]: r for r in fingerprints.edited_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), *idf).collect()}
    df = Counter(w for t in texts.values() for w in set(re.findall(r"[a-z0-9]+", t)))
    marks = {i: marks_by_hand(t, df, len(texts), *idf) for i, t in texts.items()}

    def like(a, b):
        either = sum(x != "-" or y != "-" for x, y in zip(a, b, strict=True))
        return 1.0 if a == b else sum(x == y != "-" for x, y in zip(a, b, strict=True)) / either

    order = sorted(texts, reverse=True)
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        half = len(texts[a]) // 2
        edited = texts[a][: len(texts[a]) - half] + texts[b][:half]
        new = marks_by_hand(edited, df, len(texts), *idf)
        assert rows[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[a]["fingerprint"] == ":".join(marks[a]) and rows[a]["edited_fingerprint"] == ":".join(new)
        assert rows[a]["near_edited"] == pytest.approx(like(marks[a], new)) and rows[a]["near_next"] == pytest.approx(like(marks[a], marks[b]))
    assert marks[1 << 62][0][0] == "=" and rows[1 << 62]["near_next"] == 0


def test_next_rows_of_repeated_and_distant_ids(spark):
    rows = [(7, f"text {i}") for i in range(300)] + [(1 << 60, "far"), (None, "null id"), (3, "x"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprints.with_next(df, "text", rows_a_range=8).collect()
    assert sorted(r["next_text"] for r in got) == sorted(t for _, t in rows)  # every row follows one row
    places = {(r["range"], r["nth"]): r for r in got}
    assert len(places) == len(rows) and all(places[r["next_range"], r["next_nth"]]["text"] == r["next_text"] for r in got)
    assert max(Counter(r["range"] for r in got).values()) < 100
    assert next(r["next_text"] for r in got if r["doc_id"] is None) == "far"


def test_fingerprints_of_odd_rows(odd_documents, no_documents):
    rows = fingerprints.edited_report(odd_documents).collect()
    assert len(rows) == 10 and {r["n_chars"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert fingerprints.edited_report(no_documents).count() == 0 and fingerprints.fingerprint_documents(odd_documents).count() == 10


# ---- 3: toxicity ----


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = [], []
    for i in range(600):
        toxic = int(i % 4 == 0)
        words = prose(i, 60).split()
        if toxic:
            for k in range(5):
                words[7 * k] = ["idiot", "moron", "scum"][(i + k) % 3]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled):
    rows = toxicity.score_toxicity(*labelled).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 600 and sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)


def evidence_by_hand(n, of):
    share = of[1] / sum(of)
    return 2 * sum(x * math.log(x / (sum(n) * q)) for x, q in zip(n, (1 - share, share), strict=True) if x)


def test_kneser_ney_models_by_hand(labelled):
    """Both models are distributions, and give every word of a text the ratio that a plain model gives it."""
    docs, labels = labelled
    sample = docs.join(labels, "doc_id").select("doc_id", "text", "toxic")
    # a telling pair whose second word tells nothing by its contexts
    sample = sample.union(docs.sparkSession.createDataFrame([(9_000 + i, f"grim lake {i}", 1) for i in range(40)], sample.schema))
    model = toxicity.fit_kneser_ney(sample)
    pairs, words = [Counter(), Counter()], set()
    for r in sample.collect():
        w = r["text"].split()
        words.update(w)
        pairs[r["toxic"]].update(zip(w, w[1:], strict=False))
    ends = [Counter(b for _, b in p) for p in pairs]
    followed = {b for p in pairs for _, b in p}
    names = sorted(words)
    data = "".join(names).encode()
    edges = np.concatenate([[0], np.cumsum([len(x.encode()) for x in names])])
    h = dict(zip(names, find_words(np.frombuffer(data, np.uint8), edges).hash(), strict=True))
    total, in_pairs = [sum(e.values()) for e in ends], [sum(p.values()) for p in pairs]
    told = {x for x in followed if evidence_by_hand([e[x] for e in ends], total) >= 10}
    strong = {ab for ab in {*pairs[0], *pairs[1]} if evidence_by_hand([p[ab] for p in pairs], in_pairs) >= 20}
    assert {"idiot", "moron", "scum"} <= told and ("grim", "lake") in strong and "lake" not in told
    assert {x for x in names if h[x] in model.words} == told | {b for _, b in strong}
    shared = {x: sum(e[x] for e in ends) for x in followed}
    known, rest = sum(shared[x] for x in told), sum(shared[x] for x in followed - told) + 1

    def word(c, x):
        mass = (max(0, total[c] - sum(ends[c][y] for y in told)) + 1) / total[c]
        own = {y: (max(ends[c][y] - 0.75, 0) + 0.75 * max(1, sum(ends[c][z] > 0 for z in told)) * shared[y] / known) / total[c] for y in told}
        return (own[x] if x in told else mass * shared.get(x, 1) / rest) / (sum(own.values()) + mass)

    for c in (0, 1):
        assert sum(word(c, x) for x in {*followed, "never seen"}) == pytest.approx(1)
    p_word = {x: [word(c, x) for c in (0, 1)] for x in {*names, "neverseen"}}
    histories = {a for a, _ in strong}
    out = {a: [sum(n for (x, _), n in p.items() if x == a) for p in pairs] for a in histories}
    given = {ab: [max(p[ab] - 0.75, 0) / max(1, out[ab[0]][c]) for c, p in enumerate(pairs)] for ab in strong}
    left = {a: [1 - sum(g[c] for (x, _), g in given.items() if x == a) for c in (0, 1)] for a in histories}
    for text in [*(r["text"] for r in sample.limit(40).collect()), "neverseen idiot neverseen", " ".join(f"{a} {b} neverseen" for a, b in sorted(strong)[:20])]:
        w = text.split()
        p = [[p_word[x][c] if a not in histories else left[a][c] * p_word[x][c] + given.get((a, x), (0, 0))[c] for c in (0, 1)] for a, x in zip([None, *w], w, strict=False)]
        raw = np.frombuffer(text.encode(), np.uint8)
        assert model.log_ratio(find_words(raw, np.array([0, len(raw)]))) == pytest.approx([math.log(t) - math.log(o) for o, t in p])
    for k, a in enumerate(model.histories):  # what pairs are given and what is left to the words is everything
        mine = [j for (x, y) in {*pairs[0], *pairs[1]} if h[x] == a for j in np.flatnonzero(model.pairs == toxicity.pair_hash(np.array([h[x]]), np.array([h[y]]))[0])]
        assert model.given[:, mine].sum(axis=1) + model.left[:, k] == pytest.approx(np.ones(2))


def test_toxicity_of_odd_rows(spark, odd_documents, no_documents, labelled):
    empty = labelled[1].limit(0)
    rows = toxicity.score_toxicity(odd_documents, empty).collect()
    assert len(rows) == 10 and {r["predicted"] for r in rows} == {0} and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(no_documents, labelled[1]).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (1, 1, None), (1, 1, 1), (1, 0, 0)], labelled[1].schema)
    assert toxicity.score_toxicity(odd_documents, nulls).count() == 10


# ---- 5: packing ----


def test_packing_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    texts = [prose(i, 20 + 37 * (i % 60)) for i in range(150)] + ["", "  double  spaces ", "don't <|endoftext|> we'll\n\n x", "ünï 日本 🙂 ", "tab\t x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(df, BPE, together=64).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids, at = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes())) and (r["length"] == 1024 or k == 0)
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_seq) <= 1.05 * math.ceil(sum(r["length"] for r in rows) / 1024) + 1


def test_local_search_beats_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(150, 700, 200)
        where, offset = packing.pack(sizes)
        fill = np.bincount(where, sizes)
        assert fill.max() <= 1024 and len(np.unique(where)) == where.max() + 1 <= len(packing.best_fit_decreasing(sizes, 1024))


def test_packing_of_odd_rows(odd_documents, no_documents):
    rows = packing.pack_documents(odd_documents, BPE).collect()
    assert sum(r["piece"] == 0 for r in rows) == 10 and {r["length"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert packing.pack_documents(no_documents, BPE).count() == 0


# ---- 7: language ID ----


def test_language_held_out_and_switched(spark):
    stems = {"de": ["schung", "keit", "lich", "ung", "ver", "ein"], "fr": ["eaux", "ment", "oir", "elle", "que", "aire"], "es": ["ción", "mente", "ado", "ar", "ez", "os"]}
    rng = random.Random(5)
    word = lambda lang: "".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in enumerate(rng.choice(list(stems)) for _ in range(240))]
    docs.append((999, " ".join([word("de") for _ in range(25)] + [word("fr") for _ in range(8)]), None))
    rows = {r["doc_id"]: r for r in langid.identify_language(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    held = [(i, lang) for i, _, lang in docs[:-1] if rows[i]["held_out"]]
    assert len(held) > 30 and all(rows[i]["lang_pred"] == lang for i, lang in held) and rows[999]["lang_pred"] == "de" and rows[999]["score"] < 0.95


def test_posteriors_by_enumeration():
    rng = np.random.default_rng(1)
    energy, transitions = rng.normal(size=(150, 3)), rng.normal(size=(3, 3))
    begins = np.zeros(150, bool)
    begins[[0, 40, 41, 70]] = True
    got = langid.posteriors(energy, begins, transitions, block=16)
    for a, b in ((0, 40), (40, 41), (41, 70), (70, 150)):
        e = np.exp(energy[a:b])
        alpha, beta = [e[0]], [np.ones(3)]
        for t in range(1, b - a):
            alpha.append(alpha[-1] @ np.exp(transitions) * e[t])
            alpha[-1] /= alpha[-1].sum()
        for t in range(b - a - 1, 0, -1):
            beta.append(np.exp(transitions) @ (e[t] * beta[-1]))
            beta[-1] /= beta[-1].sum()
        p = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[a:b], p / p.sum(axis=1, keepdims=True))


def test_expected_transitions_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(7)
    energy, transitions = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    begins = np.array([True, False, False, False, False])
    forward, p = langid.messages(energy, begins, transitions, block=2)
    got = langid.pair_posteriors(forward, p, transitions)
    want, total = np.zeros((4, 3, 3)), 0.0
    for labels in product(range(3), repeat=5):
        weight = np.exp(sum(energy[t, c] for t, c in enumerate(labels)) + sum(transitions[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        total += weight
        for t in range(4):
            want[t, labels[t], labels[t + 1]] += weight
    assert np.allclose(got, want / total)
    # the gradient of the logarithm of the sum over all labellings, by finite differences
    log_sum = lambda tr: np.log(sum(np.exp(sum(energy[t, c] for t, c in enumerate(x)) + sum(tr[a, b] for a, b in zip(x, x[1:], strict=False))) for x in product(range(3), repeat=5)))
    for i, j in ((0, 0), (1, 2), (2, 1)):
        step = np.zeros((3, 3))
        step[i, j] = 1e-5
        assert got.sum(axis=0)[i, j] == pytest.approx((log_sum(transitions + step) - log_sum(transitions - step)) / 2e-5, abs=1e-6)


def test_language_sample_is_bounded_where_ids_repeat(spark):
    one = next(i for i in range(8) if zlib.crc32(str(i).encode()) % 4 != 2)
    docs = [(one, f"das ist ein text nummer {i}", "de") for i in range(500)] + [(i, f"the text number {i}", "en") for i in range(8, 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    seen = []
    real = langid.fit_field
    langid.fit_field = lambda texts, langs: seen.append(Counter(langs)) or real(texts, langs)
    try:
        rows = langid.identify_language(df, a_language=50).collect()
    finally:
        langid.fit_field = real
    assert sum(r["lang_pred"] == ("de" if r["doc_id"] == one else "en") for r in rows) > 780
    assert 0 < seen[0]["en"] <= 50 and 0 < seen[0]["de"] <= 50


def test_language_of_odd_rows(odd_documents, no_documents):
    rows = langid.identify_language(odd_documents).collect()
    assert len(rows) == 10 and all((r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4, 5)) for r in rows)
    assert langid.identify_language(no_documents).count() == 0


# ---- 8: secrets ----

BASE = {"assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}


def by_regex(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, (p, g, least)) in enumerate(BASE.items()) for m in re.finditer(p, text) if len(m[g]) >= least]
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(spans))


def test_secrets_equal_the_regexes(spark):
    rng = random.Random(3)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abc123", "hunter2x", "AKIA", "ABCDEFGH12345678", "deadbeef0123456789abcdef", "ff", "é", "🙂", "\n", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890ab"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    rows = {r["doc_id"]: r for r in secrets.secret_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["base_sha256"] == hashlib.sha256(by_regex(t).encode()).hexdigest(), t
        assert set(filter(None, by_regex(t).split(","))) <= set(rows[i]["spans"].split(","))


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == []
    assert secrets.trigram_query(r"AKIA[A-Z0-9]{16,}") == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in secrets.trigram_query(BASE["assign"][0])


def test_secrets_of_odd_rows(odd_documents, no_documents):
    rows = secrets.secret_report(odd_documents).collect()
    assert len(rows) == 10 and sum(r["n_assign"] for r in rows) == 1
    clean = secrets.redact_secrets(odd_documents)
    assert clean.columns == odd_documents.columns and clean.where(F.col("doc_id").isNull()).first()["text"] == "a text whose id is null, with [assign]"
    assert sorted(map(str, clean.where("doc_id is not null").collect())) == sorted(map(str, odd_documents.where("doc_id is not null").collect()))
    assert secrets.secret_report(no_documents).count() == 0


# ---- 9: BagMinHash ----


def bags(texts):
    out = []
    for t in texts:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        out.append(Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    return out


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def test_near_duplicates_by_brute_force(spark):
    rng, texts = random.Random(8), []
    shared = prose(77, 60)
    for g in range(25):
        base = prose(100 + g, 80).split()
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                copy[rng.randrange(80)] = "edited"
            texts.append(" ".join(copy))
    texts += [shared + " " + prose(900 + i, 25) for i in range(30)] + [prose(5, 3), prose(5, 3), "same " * 40, "same " * 48]
    b = bags(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(b[i], b[j]) >= 0.8:
                a, c = root[i], root[j]
                root = [min(a, c) if r in (a, c) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert rows == dict(enumerate(root))


def test_signatures_are_unbiased():
    texts = ["a b c d e f g " * 3, "a b c d e f g " * 5 + "h i j"]
    import pyarrow as pa

    agree = []
    for salt in range(30):
        batch = pa.RecordBatch.from_arrays([pa.array([t.replace("a", f"a{salt}") for t in texts])], ["text"])
        for _, data, first in text_chunks(batch.column("text")):
            text, key, times = minhash.shingles(find_words(data, first))
            s = minhash.bag_min_hash(text, key, times, 2)
            agree.append((s[0] == s[1]).mean())
    b = bags(texts)
    assert np.mean(agree) == pytest.approx(jaccard(*b), abs=0.03)


def test_near_duplicates_of_an_id_with_two_texts(spark):
    a, b = prose(1, 80), prose(2, 80)
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    df = spark.createDataFrame([(1, a), (1, b), (2, near(a)), (3, near(b)), (4, prose(3, 80)), (4, near(a))], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert rows == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 4, True)]
    import corpus_pipeline

    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (1, b), (4, prose(3, 80))])


def test_cells_find_what_brute_force_finds(spark):
    """One group of noisy copies, of whose pairs some lie just below the similarity, in cells of few rows."""
    rng = random.Random(4)
    base = prose(500, 120).split()
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            copy[rng.randrange(120)] = rng.choice(WORDS) + "x"
        texts.append(" ".join(copy))
    b = bags(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(b[i], b[j]) >= 0.8 and root[i] != root[j]:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, block=16).collect()} == dict(enumerate(root))
    assert 1 < len(set(root)) < 150


def test_near_duplicates_of_odd_rows(odd_documents, no_documents):
    rows = minhash.near_duplicates(odd_documents).collect()
    assert len(rows) == 10 and {r["doc_id"]: r["kept"] for r in rows}[8] is False and sum(not r["kept"] for r in rows) == 1
    assert minhash.near_duplicates(no_documents).count() == 0


# ---- 10: Pitman-Yor ----


def test_lm_base_and_score(spark):
    docs = [(i, prose(i, 50) + ("\tCafé\x0b" if i % 3 else "")) for i in range(120)] + [(500, None), (501, "")]
    rows = {r["doc_id"]: r for r in pitman_yor.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), ""] for i, t in docs}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, t in tokens.items() if i not in held for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs=1e-6) and r["score"] < 0


def test_speller_is_a_distribution():
    rng = np.random.default_rng(0)
    key = np.unique((rng.integers(97, 102, 400) << 16) | (rng.integers(97, 102, 400) << 8) | rng.integers(97, 102, 400))
    speller = pitman_yor.fit_speller(key, rng.integers(1, 9, len(key)).astype(float))
    for context in (0, 0x6161, 0x6261, 0x7A61, 0x7A7A):
        assert (10 ** speller.log10((context << 8) | np.arange(256))).sum() == pytest.approx(1)


def lm_scores(spark, rows, parts, monkeypatch=None):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(df).collect()}


def test_lm_depends_on_order_but_not_on_partitions(spark):
    trained = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2][:60]
    held = [i for i in range(400, 900) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    line = "the cat sat on the mat and the dog ran to the park"
    rows = [(i, f"{line} {prose(i, 5)}") for i in trained] + [(held[0], line), (held[1], " ".join(sorted(line.split()))), (held[2], "zzzq " * 3)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    two = lm_scores(spark, rows, 2)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    seven = lm_scores(spark, rows, 5)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert two[held[0]] > two[held[1]] + 3 and two[held[0]] > two[held[2]]
    assert all(two[i] == pytest.approx(seven[i], abs=1e-9) for i in two)


def test_lm_rows_of_many_buckets_are_made_at_once():
    """A slice's rows come in one batch, however many buckets there are, and are those of a loop over the buckets."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    edges = np.append(0, np.cumsum(rng.integers(0, 9, 40)))
    x = rng.integers(0, 1 << 32, edges[-1])
    rows = pitman_yor.plane_rows(x, edges)
    assert rows.to_pylist() == [pitman_yor.planes(x[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    cut = pa.chunked_array([rows.slice(3, 20), rows.slice(23, 0), rows.slice(23, 9)])
    got, sizes = pitman_yor.unpacked_rows(cut)
    assert got.tolist() == x[edges[3] : edges[32]].tolist() and sizes.tolist() == np.diff(edges)[3:32].tolist()
    texts = [prose(i, 40) for i in range(12)] + [""]
    data, first = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    w, none = find_words(data, first, pitman_yor.NOT_SPACE), np.zeros(0, np.int64)
    made = pitman_yor.occurrence_rows(w, np.arange(13) % 2, pitman_yor.Contexts(none.astype(np.uint64), none, none, [], none), 5000, 7)
    assert isinstance(made, pa.RecordBatch) and made["bucket"].to_pylist() == sorted(set(made["bucket"].to_pylist())) and set(made["slice"].to_pylist()) == {7}
    told = Counter()
    for row in made.to_pylist():
        at, per_word = 0, np.repeat(np.arange(len(pitman_yor.numbers(row["sizes"]))), pitman_yor.numbers(row["entries"]))
        spelt = []
        for size in pitman_yor.numbers(row["sizes"]).tolist():
            spelt.append(row["spelling"][at : at + size].decode())
            at += size
        for k, doc, times in zip(per_word.tolist(), pitman_yor.numbers(row["docs"]).tolist(), pitman_yor.numbers(row["times"]).tolist(), strict=True):
            told[spelt[k], doc] += times
    want = Counter((word, 2 * i + i % 2) for i, t in enumerate(texts) for word in [*t.split(), ""])
    assert told == want and made.num_rows > 80


def test_lm_pairs_are_brought_together(monkeypatch):
    """Every pair's context and count, and what the endings' restaurants get at first, against plain loops."""
    halls = []
    monkeypatch.setattr(pitman_yor, "SHARE", 40)
    texts = [prose(i, 12) for i in range(30)]
    batch = [w for t in texts for w in [*t.split(), ""]]
    n = Counter(batch)
    raw = sorted(w.encode() for w, k in n.items() if k >= max(2, -(-len(batch) // 40)))
    w = pitman_yor.spell_table(raw)
    order = np.argsort(w.hash())
    contexts = pitman_yor.Contexts(w.hash()[order], np.array([n[raw[i].decode()] for i in order]), pitman_yor.endings(w, np.arange(len(raw)))[order], [raw[i] for i in order], np.ones(len(raw), int))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    blobs = list(pitman_yor.occurrences(find_words(data, first, pitman_yor.NOT_SPACE), np.zeros(30, int), contexts, 3))
    for b in {x["bucket"] for x in blobs}:
        rows = [pitman_yor._row(slice=0, **x) for x in blobs if x["bucket"] == b]
        import pyarrow as pa

        halls += [pitman_yor.Hall(r, contexts) for r in pitman_yor.brought_together(pa.Table.from_batches(rows), 20).to_pylist()]
    codes = {x.decode(): k for k, x in enumerate(contexts.raw)}
    ending = lambda x: (x[-1] | (x[-2] if len(x) > 1 else 0x20) << 8)
    pairs = Counter()
    for t in texts:
        before = None
        for word in [*t.split(), ""]:
            g = pitman_yor.ENDINGS - 1 if before is None else ending(before.encode())
            pairs[word, codes.get(before, None), g] += 1
            before = word
    found = Counter()
    for h in halls:
        words = [h.words.data[a:b].tobytes().decode() for a, b in zip(h.words.start, h.words.end, strict=True)]
        for k in range(len(h.c)):
            found[words[h.word[k]], int(h.code[k]) if h.own[k] else None, int(h.ending[h.at_ending[k]])] += h.c[k]
    assert found == pairs
    assert sum(h.c_ending.sum() for h in halls) == sum(1 if k is not None else c for (_, k, _), c in pairs.items())


def test_lm_predictions_sum_to_one():
    rng = np.random.default_rng(4)
    words = [f"w{i}".encode() for i in range(12)]
    w = pitman_yor.spell_table(words)
    order = np.argsort(w.hash())
    contexts = pitman_yor.Contexts(w.hash()[order][:3], np.array([9, 9, 9]), np.array([300, 301, 300]), [words[i] for i in order[:3]], np.ones(3, int))
    counts = rng.integers(0, 4, (12, 5))  # after three frequent words, and after the endings 300 and 301 alone
    codes = np.array([0, 1, 2, 3 + 300, 3 + 301])
    ranks = np.sort(contexts.rank_of[codes])
    by_rank = counts[:, [codes.tolist().index(contexts.code_of[r]) for r in ranks]]
    row = {"spelling": b"".join(words), "sizes": pitman_yor.planes(np.array(list(map(len, words)))), "pairs": pitman_yor.planes(np.full(12, 5)), "ranks": pitman_yor.planes(np.tile(ranks, 12)), "trained": pitman_yor.planes(by_rank.ravel(), 8)}
    hall = pitman_yor.Hall(row, contexts)
    spelling = np.full(12, 0.01)

    def totals():
        by = {}
        for kind, key, value in hall.sums():
            by.setdefault(kind, []).append((key, value))
        full = lambda k, n: sum(np.bincount(a, b, n) for a, b in by[k])
        often = full(5, 3)
        tables = np.minimum(often, 1)
        return pitman_yor.Totals(full(6, 3), full(0, 3), full(1, pitman_yor.ENDINGS), full(2, pitman_yor.ENDINGS), often, tables, full(3, 1)[0] + often.sum(), full(4, 1)[0] + tables.sum())

    discounts, now = [0.7, 0.6, 0.5], totals()
    for number in range(1, 4):
        hall.sweep(number, now, discounts, spelling)
        now = totals()
        assert (hall.t <= hall.c).all() and ((hall.t > 0) == ((hall.c > 0) & hall.own)).all() and (hall.t_ending <= hall.c_ending).all()
        pair = hall.probabilities(now, discounts, spelling)[2].reshape(12, 5)
        unseen = (pitman_yor.STRENGTH + discounts[2] * now.root_t) / (pitman_yor.STRENGTH + now.root_n)
        for k, r in enumerate(ranks):
            code = contexts.code_of[r]
            g = contexts.ending_of[code]
            left = unseen * (pitman_yor.STRENGTH + discounts[1] * now.ending_t[g]) / (pitman_yor.STRENGTH + now.ending_n[g])
            if code < 3:
                left *= (pitman_yor.STRENGTH + discounts[0] * now.context_t[code]) / (pitman_yor.STRENGTH + now.context_n[code])
            assert pair[:, k].sum() + left * (1 - 12 * 0.01) == pytest.approx(1)  # the rest of the spellings


def seatings(c, other, p, d):
    """The distribution of the number of tables, by every partition of few customers, by the recursion for more."""
    weight = {}
    if c <= 8:
        def walk(n, sizes, w):
            if n == c:
                opening = math.prod((pitman_yor.STRENGTH + d * (other + i)) * p for i in range(len(sizes)))
                weight[len(sizes)] = weight.get(len(sizes), 0.0) + w * opening
                return
            for i, size in enumerate(sizes):
                walk(n + 1, [*sizes[:i], size + 1, *sizes[i + 1 :]], w * (size - d))
            walk(n + 1, [*sizes, 1], w)

        walk(0, [], 1.0)
    else:
        s = {0: 0.0}
        for n in range(c):  # logarithms
            new = {}
            for t, x in s.items():
                for to, y in ((t + 1, x), (t, x + math.log(n - t * d) if n > t * d else -math.inf)):
                    if y > -math.inf:
                        m = max(y, new.get(to, -math.inf))
                        new[to] = m + math.log(math.exp(y - m) + math.exp(new.get(to, -math.inf) - m))
            s = new
        logs = {t: x + sum(math.log((pitman_yor.STRENGTH + d * (other + i)) * p) for i in range(t)) for t, x in s.items()}
        top = max(logs.values())
        weight = {t: math.exp(x - top) for t, x in logs.items()}
    total = sum(weight.values())
    mean = sum(t * w for t, w in weight.items()) / total
    return mean, math.sqrt(sum(t * t * w for t, w in weight.items()) / total - mean**2)


@pytest.mark.parametrize(("c", "other", "p", "d"), [(2, 0, 0.2, 0.5), (3, 4, 0.2, 0.5), (6, 0, 0.2, 0.5), (8, 2, 0.4, 0.7), (12, 5, 0.1, 0.6), (30, 50, 0.2, 0.5), (100, 0, 0.2, 0.5), (256, 9, 0.05, 0.8), (257, 50, 0.2, 0.5), (600, 0, 0.001, 0.5), (700, 900, 0.1, 0.75)])
def test_a_gibbs_step_has_the_seatings_distribution(c, other, p, d):
    n = 40_000
    t = pitman_yor.seat(np.full(n, float(c)), np.full(n, float(other)), np.full(n, p), pitman_yor.mix(np.arange(n, dtype=np.uint64)), d)
    mean, deviation = seatings(c, other, p, d)
    assert t.mean() == pytest.approx(mean, rel=0.01) and t.std() == pytest.approx(deviation, rel=0.05, abs=0.02)
    assert ((t >= 1) & (t <= c)).all() and (pitman_yor.seat(np.zeros(3), np.zeros(3), np.full(3, p), np.arange(3, dtype=np.uint64), d) == 0).all()


def test_lm_tables_of_large_rows_are_held_in_small_parts(spark, monkeypatch, tmp_path):
    """A task holds a whole row group of the halls, and a whole Arrow batch: both are bounded."""
    from pyspark.sql import DataFrame

    from gradewalk.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    large = spark.range(0, 40, 1, 1).withColumn("blob", F.expr("aggregate(sequence(1, 4000), '', (t, i) -> concat(t, sha2(concat(id, ':', i), 256)))"))
    assert isinstance(common.cut(large, 1_000_000), DataFrame)
    groups = [pq.ParquetFile(f).metadata for f in tmp_path.glob("*/*.parquet")]
    sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) == 40 and max(sizes) <= 8
    pitman_yor.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 4_000_000


def test_lm_of_odd_rows(odd_documents, no_documents):
    rows = pitman_yor.score_texts(odd_documents).collect()
    assert len(rows) == 10 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert pitman_yor.score_texts(no_documents).count() == 0


# ---- the pipeline ----


def test_pipeline_on_odd_rows(spark, odd_documents, labelled, tmp_path):
    import corpus_pipeline

    labelled[1].write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert name == "best_fit_packing" or docs.columns == before.columns
    kept = {r["doc_id"] for r in docs.collect()}
    assert {1, 6, 7, None} == kept


def test_queries_have_the_contracts_columns(spark, tmp_path, odd_documents, labelled):
    from gradewalk.llm.queries import QUERIES

    odd_documents.write.parquet(str(tmp_path / "documents.parquet"))
    labelled[1].write.parquet(str(tmp_path / "labels.parquet"))
    want = {"op3_toxicity": "doc_id held_out score predicted", "op7_language_id": "doc_id held_out lang_pred score", "op8_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans"}
    for name, columns in want.items():
        assert QUERIES[name](spark, str(tmp_path)).columns == columns.split()
    assert json.dumps(want)


@pytest.mark.parametrize("most", [40, 10_000])
def test_halls_sums_leave_a_task_together(most):
    """One row a slice, each document once, while the bound isn't met; never a document lost or counted twice."""
    rng = np.random.default_rng(3)
    sums, want, rows = pitman_yor.DocumentSums(most), {}, []
    for slices in ([70, 5], [70, 5], [5, 9 << 33], [1]) * 3:
        at, doc, x = rng.integers(0, len(slices), 50), rng.integers(0, 12, 50), rng.integers(1, 9, 50)
        for a, d, v in zip(at.tolist(), doc.tolist(), x.tolist(), strict=True):
            want[slices[a], d] = want.get((slices[a], d), 0) + v
        sums.add(np.array(slices), at << pitman_yor.DOC_BITS | doc, -x / 8, x / 4, x)
        if sums.full:
            rows += sums.taken()
    rows += sums.taken()
    got = {}
    for r in rows:
        docs, score, base, known = pitman_yor.numbers(r["docs"]), pitman_yor.doubles(r["score"]), pitman_yor.doubles(r["base"]), pitman_yor.numbers(r["known"])
        assert len(set(docs.tolist())) == len(docs) and (score == -known / 8).all() and (base == known / 4).all()
        for d, v in zip(docs.tolist(), known.tolist(), strict=True):
            got[r["slice"], d] = got.get((r["slice"], d), 0) + v
    assert got == want and list(sums.taken()) == []
    assert (len(rows) == 4) == (most == 10_000)


def test_fingerprints_travel_as_numbers(spark):
    """Four bytes a subset where rows are shuffled; texts only at the end, with signs as unsigned digits."""
    bands = [([(i * 0x9E3779B97F4A7C15 + 77) % 2**63 for i in range(n)], -n) for n in (0, 1, 40, 300)]
    made = spark.createDataFrame(bands, "band array<long>, every long").withColumn("m", fingerprints.hashes("band", "every"))
    assert made.schema["m"].dataType.simpleString() == "struct<bare:boolean,first:bigint,rest:array<int>>"
    rows = made.select("m", fingerprints.written_out("m").alias("t"), fingerprints.likeness("m", "m").alias("near")).collect()
    for r in rows:
        first = ("=" if r["m"]["bare"] else "") + f"{r['m']['first'] & (2**64 - 1):016X}"
        assert r["t"] == [first, *("-" if x is None else f"{x & (2**32 - 1):08X}" for x in r["m"]["rest"])] and r["near"] == 1.0
    assert rows[0]["m"]["bare"] and set(rows[0]["m"]["rest"]) == {None} and any(x is not None and x < 0 for x in rows[3]["m"]["rest"])
