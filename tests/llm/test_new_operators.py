"""URL filters, whitening and tokenizer alignment against brute force."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest_llm import EDGES, prose
from pyspark.sql import functions as F

from millrace.llm import exact_roots, token_alignment, url_filters, whitening
from millrace.llm.queries import BYTE_VOCABULARY, PIECE_MODEL

URLS = [None, "", "no scheme/en/", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/1", "https://example.com/EN/1",
        "https://a.example.com/en", "https://notexample.com/en/", "https://wwwexample.com/en/", "https://x.www.example.com/en/2", "http://a.net/es/", "http://a.net/fr/?q",
        "http://a.net/?/fr/", "http://a.net#/fr/", "ftp://spam-farm.org/x", "http://b.spam-farm.example.net/de/", "http://cheap-pills.io", "http://not-cheap-pills.io",
        "http://a.org/wp-login.php", "http://a.org/wp-login.php5", "http://a.org/adclick", "http://a.org/adclick_x", "http://ü.org/casino-bonus/", "http://x.org/a\nb",
        "http://x:80/com/", "https://u@evil.com/", "http://a.b://com/", "http://example.com/en/", "http://example.com/en/"]


@pytest.fixture(scope="session")
def pages_of(spark):
    def make(urls):
        return spark.createDataFrame([(k if k % 5 else None, u) for k, u in enumerate(urls)], "page_id LONG, url STRING").select(
            "*", *[F.lit("extra").alias(c) for c in ("host", "path", "rule", "row", "token", "text", "entry", "verdict")])

    return make


def _brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host):]).group(0)
    host = "".join(c.lower() if c.isascii() else c for c in host)
    hits = []
    for rule in rules:
        if rule.listed:
            h, p = rule.text.split("/", 1)
            hit = (host == h or host.endswith("." + h)) and path.startswith("/" + p)
        else:
            hit = re.search(rule.regex, "".join(c.lower() if c.isascii() else c for c in host + path) + "#")
        if hit:
            hits.append((not rule.listed, -len(rule.text), rule.text, rule.action))
    general, _, text, action = min(hits, default=(None, 0, None, "allow"))
    return host, path, None if general else text, action, text if general else None


@pytest.mark.parametrize("most", [100_000, 0])
def test_urls_against_every_rule(spark, pages_of, rows, most):
    rules = url_filters.compiled()
    table = url_filters.rule_table(spark, rules)
    got = rows(url_filters.judge(pages_of(URLS), table, broadcast_rules=most))
    assert got == sorted([(k if k % 5 else None, *_brute_verdict(u, rules)) for k, u in enumerate(URLS)], key=repr)


def test_urls_hot_tokens_are_salted_to_the_same_verdicts(spark, pages_of, rows, monkeypatch):
    urls = URLS + [f"http://h{k}.example.com/en/{k}" for k in range(60)]
    table = url_filters.rule_table(spark, url_filters.compiled())
    want = rows(url_filters.judge(pages_of(urls), table))
    monkeypatch.setattr(url_filters, "SALTED", 7)
    assert rows(url_filters.judge(pages_of(urls), table, broadcast_rules=0)) == want


def test_every_token_of_a_rule_is_whole_in_what_it_matches():
    cases = [("||spam-*.", ("spam",)), ("||cheap-pills.", ("cheap", "pills")), ("casino", ()), ("-casino.", ("casino",)), ("/wp-login.php|", ("login", "php", "wp")),
             ("||x*y.", ()), ("/Ad^", ("ad",))]
    assert [url_filters.general_rule("block", text).tokens for text, _ in cases] == [tokens for _, tokens in cases]
    assert url_filters.listed_rule("allow", "a-b.com/en/pre").tokens == ("a", "b", "com", "en")
    for bad in (("maybe", "com/"), ("block", "com"), ("block", "/x")):
        with pytest.raises(ValueError):
            url_filters.compiled(listed=[bad], general=[])
    with pytest.raises(ValueError):
        url_filters.compiled(listed=[], general=[("block", "||*^|")])


def test_rules_index_by_their_rarest_token(spark, pages_of):
    rules = url_filters.rule_table(spark, url_filters.compiled(listed=[("block", "rare.example.com/en/")], general=[("block", "x")]))
    urls = pages_of(["http://a.example.com/en/"] * 5 + ["http://rare.example.com/en/"]).select("url")
    host, path = url_filters._parts(F.col("url"))
    for small in (True, False):
        found = {r.text: (r.entry, r.n) for r in url_filters.index(urls.select(host.alias("host"), path.alias("path")), rules, small).collect()}
        assert found == {"rare.example.com/en/": ("rare", 1), "x": ("", 6)}


def test_urls_without_pages_or_rules(spark, pages_of, rows):
    none = url_filters.rule_table(spark, [])
    assert rows(url_filters.judge(pages_of([]), url_filters.rule_table(spark, url_filters.compiled()))) == []
    assert {r[4] for r in rows(url_filters.judge(pages_of(URLS), none))} == {"allow"}


# -- whitening -----------------------------------------------------------------------------------

@pytest.fixture(scope="session")
def embeddings_of(spark):
    def make(vectors):
        return spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id LONG, embedding ARRAY<FLOAT>").select(
            "*", *[F.lit("extra").alias(c) for c in ("vector", "component", "n", "total", "power", "whitened")])

    return make


def _vectors(n, d, seed=3):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.linspace(2, 0.2, d)
    return (rng.normal(size=(n, d)) @ mix).astype(np.float32)


def test_whitening_against_dense_algebra(spark, embeddings_of):
    vectors = _vectors(300, 20)
    rows = [[float(x) for x in v] for v in vectors]
    odd = [None, [], [1.0] * 19, [float("nan")] + [0.0] * 19, [None] + [0.0] * 19, [float("inf")] + [0.0] * 19]
    table = embeddings_of(rows + odd + rows[:120] + [rows[0]] * 50)
    got = whitening.whiten(table).toPandas()
    x = np.floor(64 * vectors.astype(np.float64))
    fitted = np.unique(x, axis=0)
    n, centred = len(fitted), fitted - fitted.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:16], directions[:, ::-1][:, :16]
    answered = rows + rows[:120] + [rows[0]] * 50
    assert len(got) == 16 * len(answered) and set(got.n) == {n}
    at = [k for k, v in enumerate(rows + odd + rows[:120] + [rows[0]] * 50) if v and len(v) == 20 and all(e is not None and np.isfinite(e) for e in v)]
    white = got.pivot(index="vec_id", columns="component", values="whitened").loc[at].to_numpy()
    want = (np.floor(64 * np.array(answered)) - fitted.mean(axis=0)) @ directions / np.sqrt(values)
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white * signs - want).max() < 1e-9
    first = got[got.component == 1].set_index("vec_id").loc[at]
    sums = fitted.sum(axis=0)
    assert [int(v) for v in first.deviation] == [int(((n * np.floor(64 * np.array(v)) - sums) ** 2).sum()) for v in answered]
    assert np.allclose(got.drop_duplicates("component").set_index("component").explained.loc[range(1, 17)], values / np.trace(centred.T @ centred / n), rtol=1e-12)
    assert got.identity_error.max() < 1e-12
    measured = white[:300].T @ white[:300] / n          # the first 300 rows are the distinct ones
    assert np.abs(measured - np.eye(16)).max() < 1e-9


def test_whitening_of_degenerate_tables(spark, embeddings_of, rows):
    assert rows(whitening.whiten(embeddings_of([]))) == []
    assert rows(whitening.whiten(embeddings_of([[1.0, 2.0]] * 9))) == []
    assert rows(whitening.whiten(embeddings_of([None, [], [float("nan")]]))) == []
    # One direction of variance in three dimensions, and equal eigenvalues.
    assert {r.component for r in whitening.whiten(embeddings_of([[k / 64, 0.0, 1.0] for k in range(5)])).collect()} == {1}
    square = embeddings_of([[a, b] for a in (0.0, 1.0) for b in (0.0, 1.0)])
    got = whitening.whiten(square).toPandas()
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(white.T @ white / 4 - np.eye(2)).max() < 1e-12 and set(got.explained) == {0.5}


def test_whitening_of_huge_entries_is_exact(spark, embeddings_of):
    big = [[3e9, 1.0], [-3e12, 2.0], [5e15, 3.0], [1e30, 4.0]]
    found = whitening.moments(embeddings_of(big), "embedding", 2)
    y = [[int(v) for v in row] for row in whitening.integers(np.array(big, np.float32).astype(float))]
    assert found.n == 4 and found.sums == [sum(r[k] for r in y) for k in (0, 1)]
    assert found.products == [[sum(r[i] * r[j] for r in y) for j in (0, 1)] for i in (0, 1)]
    assert whitening.whiten(embeddings_of(big)).count() == 8


@pytest.mark.parametrize("seed", range(4))
def test_characteristic_polynomial_and_roots(seed):
    rng = np.random.default_rng(seed)
    d = [1, 2, 5, 8][seed]
    factor = rng.integers(-9, 10, (d, d + 1))
    if seed == 3:
        factor[4:] = 0                                  # zero roots, and a Hessenberg step without a pivot
    matrix = (factor @ factor.T).tolist()
    moduli = exact_roots.primes_for(matrix)
    polynomial = exact_roots.remaindered(moduli, exact_roots.residues(matrix, moduli).tolist())
    # Faddeev and LeVerrier's recurrence in fractions.
    m, coefficients = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][l] * m[l][j] for l in range(d)) + (coefficients[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        coefficients.append(-sum(sum(matrix[i][l] * m[l][i] for l in range(d)) for i in range(d)) / k)
    assert polynomial == [int(c) for c in reversed(coefficients)]
    values = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    found = [float(Fraction(a, 1 << b)) for a, b, m in exact_roots.top_roots(polynomial, d) for _ in range(m)]
    assert np.allclose(found, [v for v in values if v > 1e-6])


def test_primes():
    below = [n for n in range(400) if exact_roots.is_prime(n)]
    assert below == [n for n in range(2, 400) if all(n % k for k in range(2, n))]


# -- alignment -----------------------------------------------------------------------------------

ODD = ["  a  b \n\t x ", " ", "  ", "x ", " x", "▁", "a▁b", "<0x41> <s> </s> <unk> <|endoftext|>", "\x00 é 漢字" * 3, "I'll 'tis it's non\u00a0break\u3000wide",
       "a\r\n\r\nb   ", "\ufffd", "🙂🙂 ok", "x" * 500, "the " * 300]


def _brute_alignment(texts):
    """Every pair of tokens of every text, straight from the two libraries."""
    import sentencepiece
    import tokenizers

    a_coder = tokenizers.Tokenizer.from_file(BYTE_VOCABULARY)
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    letters = token_alignment.byte_of_letter()
    out, total = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = a_coder.encode(whole.decode(), add_special_tokens=False).ids, b_coder.encode(text or "")
        parts = ([bytes(letters[c] for c in a_coder.id_to_token(i)) for i in a],
                 [bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode() for i in b])
        if not text or b"".join(parts[0]) != whole or b"".join(parts[1]) != whole:
            out.append((0, 0, 0, Counter(), ""))
            continue
        spans = [[(sum(map(len, side[:k])), sum(map(len, side[:k + 1]))) for k in range(len(side))] for side in parts]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [[",".join(str(i) for i, (s, e) in zip(ids, side) if low <= s and e <= high) for ids, side in zip((a, b), spans)]
                  for low, high in zip([0, *cuts], cuts)]
        links = Counter((i, j) for i, (s, e) in zip(a, spans[0]) for j, (u, v) in zip(b, spans[1]) if max(s, u) < min(e, v))
        total += links
        out.append((len(a), len(b), len(cuts), links, ";".join("|".join(g) for g in groups)))
    best = {}
    for (i, j), n in total.items():
        best[j] = max(best.get(j, 0), n)
    return [(n_a, n_b, n_groups, sum(links.values()), sum(n for (i, j), n in links.items() if total[i, j] == best[j]),
             sum(n * total[p] for p, n in links.items()), text) for n_a, n_b, n_groups, links, text in out]


@pytest.mark.parametrize("hot", [500_000, 3, 0])
def test_alignment_against_all_pairs(docs_of, rows, hot):
    texts = [t for _, t in EDGES if t is None or len(t) < 2_000] + ODD + [prose(k, 40) for k in range(8)]
    docs = docs_of([(k if k % 7 else None, t) for k, t in enumerate(texts)])
    got = rows(token_alignment.align(docs, BYTE_VOCABULARY, PIECE_MODEL, hot_pairs=hot))
    assert got == sorted([(k if k % 7 else None, *r) for k, r in enumerate(_brute_alignment(texts))], key=repr)


def test_alignment_of_nothing_and_of_long_texts(docs_of, rows):
    assert rows(token_alignment.align(docs_of([]), BYTE_VOCABULARY, PIECE_MODEL)) == []
    assert rows(token_alignment.align(docs_of([(1, None), (2, "")]), BYTE_VOCABULARY, PIECE_MODEL, digest=True)) == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]
    text = prose(9, 150_000) + " end"
    [found] = token_alignment.align(docs_of([(1, text)]), BYTE_VOCABULARY, PIECE_MODEL).collect()
    assert found.n_links == found.n_a + found.n_b - found.n_groups and found.groups.count(";") + 1 == found.n_groups


def test_intervals():
    starts, ends = np.array([0, 3, 5, 0, 2, 5]), np.array([3, 5, 9, 2, 5, 9])
    assert token_alignment.coalesced(starts, ends).tolist() == [0, 0, 1, 0, 0, 1]
    left, right = token_alignment.overlaps((starts[:3], ends[:3]), (starts[3:], ends[3:]))
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]
