import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewalk.llm import pivots, urls
from gradewalk.llm.queries import URL_RULES


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(len(r), r, v) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


URLS = [None, "", "no scheme", "http://", "http://Example.COM/en/1?x#y", "https://www.example.com/en/", "https://m.www.example.com/en/x", "http://a.net/es/1", "http://a.net/fr", "http://net/fr/?q", "http://com", "http://notexample.com/en/", "http://example.com?/en/", "ftp://x.org/a://b", "http://é.Com/É"]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_urls_by_hand(spark, broadcast):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df, urls.rules_table(spark, URL_RULES), broadcast_rules=broadcast).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate([*URLS, *URLS])}


def test_urls_of_empty_tables(spark):
    df, rules = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), urls.rules_table(spark, URL_RULES)
    assert urls.filter_urls(df.limit(0), rules).count() == 0
    assert urls.filter_urls(df, rules.limit(0)).first()["verdict"] == "allow"


def test_links_by_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16))
    near = [base[rng.integers(0, 20)] + 0.12 * rng.normal(size=16) for _ in range(200)]
    vectors = [*base, *near, base[3], base[3] * 4, base[5]]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [None] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, [1.0, 2.0]), (1006, []), (None, rows[0][1])]
    # vectors that differ in length from most of the others
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in pivots.link_vectors(df.where("vec_id is null or vec_id is not null"), block=64).collect()}
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    root = list(range(len(u)))
    for i, j in zip(*np.nonzero(links), strict=True):
        a, b = root[i], root[j]
        if a != b:
            root = [min(a, b) if r in (a, b) else r for r in root]
    found = sum(got[i]["n_links"] for i in range(len(u)))
    assert 0.97 * links.sum() <= found <= links.sum()
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(u))]) > 0.97
    for i, _ in odd[:-1]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert len(got) == len(rows) + len(odd)


@pytest.mark.parametrize("sizes", [{"a_pivot": 8}, {"a_pivot": 4, "most_pivots": 128}])
def test_links_inside_a_large_group_of_noisy_copies(spark, sizes):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    vectors = np.concatenate([centre + 0.27 * rng.normal(size=(800, 64)), rng.normal(size=(1600, 64))])
    vectors = vectors[rng.permutation(len(vectors))].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in pivots.link_vectors(df, block=512, **sizes).collect()}
    u = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert links.sum() > 400 * 800
    assert [got[i] for i in range(len(u))] == links.tolist()


def test_links_of_rare_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(100, 129)]
    rows += [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.001]), (4, [-2.0, 1.0]), (5, [1.0, 2.0, 0.0, 0.0, 0.0]), (6, [1.0, 2.0, 0.0, 0.0, 0.01]), (7, [0.0, 0.0, 1.0, 0.0]), (7, [0.0, 0.0, 0.0, 1.0]), (8, [0.0, 0.0, 1.0, 0.01])]
    got = pivots.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id < 100").collect()
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
    assert found == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (7, 1, 7, True), (8, 1, 7, False)]


def test_urls_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "http://example.com/en/"), (1, "http://example.com/en/"), (1, None)], "page_id long, url string")
    rows = sorted((r["page_id"], r["verdict"]) for r in urls.filter_urls(df, urls.rules_table(spark, URL_RULES)).collect())
    assert rows == [(1, "allow"), (1, "block"), (1, "block")]


def test_links_of_empty_tables(spark):
    df = spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<float>")
    assert pivots.link_vectors(df.limit(0)).count() == 0
    assert pivots.link_vectors(df).select(F.col("kept")).first()["kept"]


def test_alike_vectors_share_pivots_however_many_there_are():
    """Isolated pairs at a cosine of 0.9 in every direction: at least 99 of 100 are candidates, with few pivots and with many."""
    draw, unit = np.random.default_rng(5), lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for size, many in ((64, 4096), (256, 1024), (64, 256)):
        points, a, side = (unit(draw.standard_normal((n, size))) for n in (many, 1000, 1000))
        side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
        b = 0.9 * a + np.sqrt(1 - 0.81) * side
        one, two = (pivots.nearest_pivots(x, points, pivots.ranks_kept(many)) for x in (a, b))
        assert np.mean([len(set(x) & set(y)) >= 2 for x, y in zip(one.tolist(), two.tolist(), strict=True)]) >= 0.99
