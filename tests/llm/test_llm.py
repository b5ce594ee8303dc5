import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import decontaminate, exact_dedup, html_text, license_scan, lm_score, ngram_join, sentencepiece_fst, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, doc string, id string, row string, text_hash string, th string, key string, lang string, stay_id string"


def table(spark, rows):
    """(doc_id, text) with columns named like what the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", None, "z", "", "k", "en", "s") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, repeated lines, nulls, empty, short and long texts."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(20, 120)) for _ in range(25)]
    passage = words(rng, 60)
    out = list(base) + [base[0]] * 4 + [base[3]] + [None, "", " ", "\n\t", "one", "One", "a b c", "A b  c", words(rng, 20_000)]
    for k in range(12):
        w = base[k % 4].split()
        w[rng.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    out += [words(rng, 30) + " " + passage + " " + words(rng, 30) for _ in range(5)]
    out += ["line again\n" * 40, "é" * 150, "aaaa" * 100, "Ünïcödé " * 30]
    return list(enumerate(out))


AWKWARD = [(3, "same words here"), (3, "same words here"), (3, "other words"), (None, None), (None, "same words here"), (7, ""), (8, None), (9, "x " * 5000)]


# --- repeated passages


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        out[i] = bytes(b for b, g in zip(raw, gone) if not g)
    return out


@pytest.mark.parametrize("most", [8_000, 5, 2])
def test_repeated_passages(spark, corpus, most):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, corpus), part_segments=most, index_bytes=2000).collect()}
    want = brute_repeats(corpus)
    assert {i: bytes(r.kept) for i, r in got.items()} == want
    for i, t in corpus:
        assert got[i].n_bytes == len((t or "").encode()) == len(want[i]) + sum(s.stop - s.start for s in got[i].spans)
        assert all(a.stop < b.start for a, b in zip(got[i].spans, got[i].spans[1:]))


def test_repeats_awkward(spark):
    long = "a sentence that is long enough to stand for a passage, as it has more than a hundred bytes in all, see here"
    rows = [(3, long), (3, long), (3, "other " + long), (None, long), (None, None), (7, ""), (8, None), (9, "x " * 500)]
    got = [(r.doc_id, r.n_bytes, bytes(r.kept).decode(), len(r.spans)) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()]
    assert len(got) == 7  # the repeated row is one document
    assert (None, len(long), long, 0) in got  # a null id comes first
    assert sorted(x for x in got if x[0] == 3) == [(3, len(long), "", 1), (3, len(long) + 6, "other ", 1)]
    assert {x[1:] for x in got if x[0] in (7, 8)} == {(0, "", 0)} and [x[2] for x in got if x[0] == 9] == ["x "]
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_run_length_index_matches_brute_force():
    rng = random.Random(1)
    for t in range(120):
        length = rng.choice([1, 2, 3, 5, 8])
        strings = [bytes(rng.choice(b"ab" if t % 2 else b"abcd") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 8))]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in strings]))).astype(np.int64)
        seen, want = set(), []
        for s in strings:
            for k in range(len(s)):
                w = s[k : k + length]
                want.append(len(w) == length and w in seen)
                if len(w) == length:
                    seen.add(w)
        assert suffix_dedup.repeated_windows(np.frombuffer(b"".join(strings), np.uint8), bounds, length).tolist() == want


def test_very_long_text_is_cut_into_parts_that_lose_nothing(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    parts = list(suffix_dedup._parts(data, np.array([0, 5000]), 100, 1000))
    windows = [bytes(p[k : k + 100]) for _, p, _ in parts for k in range(len(p) - 99)]
    assert windows == [bytes(data[k : k + 100]) for k in range(4901)]


# --- urls


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/a?q", "https://example.com/en/", "ftp://x.net/es/1#t", "http://net/fr/", "no scheme", None, "", "http://", "http://evilcom/", "http://a.com", "http://a.com/x://b", "http://x.example.com/en"] * 2
    df = spark.createDataFrame([(i, u, "h", "k", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, key string, salt int")
    got = {r.page_id: r for r in url_filter.filter_urls(df, url_filter.rule_table(spark, [*url_filter.RULES, url_filter.RULES[0]])).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S) if u and "://" in u else None
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(r), v, r) for v, r in url_filter.RULES for rh, rp in [r.split("/", 1)] if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp)]
        want = max(fits, default=(0, "allow", None))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict, got[i].key) == (host, path, want[2], want[1], "k")
    assert url_filter.filter_urls(df.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, url_filter.rule_table(spark, []), default="block").collect()} == {"block"}


# --- exact copies


@pytest.mark.parametrize(("block", "head"), [(1024, 256), (8, 4)])
def test_exact_groups(spark, corpus, block, head):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(table(spark, corpus), block_bytes=block, head_bytes=head).collect()}
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    for i, t in corpus:
        g = groups[t or ""]
        assert tuple(got[i])[1:] == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_awkward(spark):
    df = table(spark, AWKWARD)
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == len(AWKWARD)
    same = [r for r in got if r.text_sha256 == hashlib.sha256(b"same words here").hexdigest()]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in same} == {(3, 3, 3, True), (None, 3, 3, False)}
    stay = exact_dedup.drop_exact_duplicates(df)
    assert stay.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in stay.collect()) == [(3, "other words"), (3, "same words here"), (8, ""), (9, "x " * 5000)]


# --- near copies


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w[j : j + k]) for j in range(len(w) - k + 1)] or ([tuple(w)] if w else []))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_similarity_components(spark, corpus, k, percent):
    got = {r.doc_id: tuple(r)[1:] for r in ngram_join.similarity_components(table(spark, corpus), k, percent).collect()}
    assert got == brute_components(corpus, k, percent)


def test_similarity_of_many_borderline_copies(spark):
    """A large group whose members link only to some of the others."""
    rng = random.Random(9)
    base = words(rng, 120, 5000).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((1000 - i, " ".join(w)))
    got = {r.doc_id: tuple(r)[1:] for r in ngram_join.similarity_components(table(spark, rows), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_candidates_of_a_group_grow_with_its_size(spark, monkeypatch):
    """A thousand near copies, half of them beyond reach of the text they come from: no link is lost, and candidates stay few."""
    rng = random.Random(19)
    base = words(rng, 130, 5000).split()
    rows = []
    for i in range(1000):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(60)}"
        if i % 7 == 0:
            del w[rng.randrange(len(w)) :][:3]
        rows.append((i, " ".join(w)))
    written, kept = [], ngram_join.durable

    def noted(df):
        out = kept(df)
        written.append((tuple(out.columns), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "durable", noted)
    got = {r.doc_id: tuple(r)[1:] for r in ngram_join.similarity_components(table(spark, rows), 5, 80).collect()}
    want = brute_components(rows, 5, 80)
    assert got == want and 100 < len({c for _, c in want.values()}) < 900
    assert 0 < dict(written)["x", "y", "gx", "gy", "py"] < 5 * len(rows)


def test_similarity_awkward(spark):
    got = sorted(ngram_join.similarity_components(table(spark, AWKWARD), 2, 80).collect(), key=str)
    same = [r for r in got if r.n_shingles == 2 and r.doc_id is None or r.doc_id == 3]
    assert len(got) == 7  # the repeated row is one document
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in same} == {(3, 2, None), (None, 2, None), (3, 1, 3)}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id in (7, 8, 9)} == {(7, 0, 7), (8, 0, 8), (9, 1, 9)}
    assert ngram_join.similarity_components(table(spark, AWKWARD).limit(0)).count() == 0


def test_fragment_borders_share_the_occurrences_out():
    assert ngram_join.fragment_borders({16: 300, 32: 100}, 4) == [(16, int(1 / 3 * 2**64) - 2**63), (16, int(2 / 3 * 2**64) - 2**63), (16, 2**63 - 1)]
    assert ngram_join.fragment_borders({}, 4) == []


def test_near_dedup_awkward(spark):
    df = table(spark, AWKWARD)
    stay = ngram_join.drop_near_duplicates(df, 2, 80)
    assert stay.columns == df.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, (r.text or "")[:12]) for r in stay.collect()) == [(False, 0, ""), (False, 0, "same words h"), (True, 3, "other words"), (True, 7, ""), (True, 8, ""), (True, 9, "x x x x x x ")]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "x long, y long")
    assert {r.node: r.component for r in ngram_join.components(edges).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


# --- benchmark


def test_contaminated(spark):
    rng = random.Random(3)
    items = [(k, words(rng, n, 5000)) for k, n in enumerate((15, 20, 40, 57, 11, 5))] + [(6, None), (7, "")]
    docs = []
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        changed = [x if j % 8 else "changed" for j, x in enumerate(w)]
        docs.append((10 + k, words(rng, 30, 5000) + " " + (t or "").upper() + " " + words(rng, 30, 5000)))
        docs.append((20 + k, words(rng, 30, 5000) + "\n" + " ".join(changed)))
        docs.append((30 + k, " ".join(w[: len(w) // 4]) + " " + words(rng, 50, 5000)))
    docs += [(50, None), (51, ""), (52, words(rng, 3000, 5000)), (10, docs[0][1])]
    df = table(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def brute(t, item):
        a, b = (re.sub("[A-Z]", lambda x: x[0].lower(), x or "").split() for x in (t, item))
        return max((sum(0 <= d + k < len(a) and a[d + k] == x for k, x in enumerate(b)) for d in range(-len(b), len(a))), default=0)

    want = {(i, k) for i, t in docs for k, item in items if item and len(item.split()) >= 11 and (m := brute(t, item)) >= 10 and m >= len(item.split()) / 2}
    for most in (10**6, 20):
        got = decontaminate.contaminated(df, bench, max_seeds=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {(10 + k, k) for k in range(5)} <= want
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted({i for i, _ in docs} - {i for i, _ in want})
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_passages_of_long_items(spark):
    """A long passage counts however long the item is, also with substituted words; a short one does not."""
    rng = random.Random(12)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(n))) for k, n in enumerate((200, 1000))]
    docs = []
    for k, t in items:
        w = t.split()
        for j, passage in enumerate((w[60:150], w[100:120], w[100:119], [x if p % 4 else "changed" for p, x in enumerate(w[20:70])])):
            docs.append((10 * k + j, " ".join([words(rng, 40), *passage, words(rng, 40)])))
    got = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in got} >= {(0, 0, 90), (1, 0, 20), (10, 1, 90), (11, 1, 20)}
    assert not {r.doc_id for r in got} & {2, 12}


def test_repeated_stock_phrase_is_no_copy(spark):
    """A phrase of an item counts once, phrases far apart do not add up, inserted words cost little."""
    rng = random.Random(13)
    item = [f"i{j}" for j in range(30)]
    a, b, fill = " ".join(item[:11]), " ".join(item[15:26]), words(rng, 100)
    texts = [f"{a} {words(rng, 9)} {a}", " ".join([a] * 50), f"{a} {fill} {b}", f"{a} {' '.join(item[11:15])} {words(rng, 5)} {' '.join(item[15:])}", f"{b} {fill} {a} more words {b}"]
    df, bench = table(spark, list(enumerate(texts))), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.item_tokens, r.matched) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {3: (30, 30), 4: (30, 22)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()) == [0, 1, 2]


def test_seeds_hit_short_and_regularly_substituted_items(spark):
    """Every copy above the threshold of items of 10 to 15 tokens, every period of substitution, and whole shorter items."""
    items, docs = [], []

    def plant(n, patterns):
        k = len(items)
        w = [f"i{k}x{j}" for j in range(n)]
        items.append((k, " ".join(w)))
        for p in patterns:
            docs.append((k, len(docs), " ".join(["before", *[x if keep else "changed" for x, keep in zip(w, p)], "after"])))

    for n in range(10, 16):
        plant(n, [[j not in out for j in range(n)] for m in range(n - 9) for out in itertools.combinations(range(n), m)])
    for period in range(2, 12):
        for n in (20, 25, 40, 57):
            plant(n, [p for shift in range(period) if sum(p := [j % period != shift for j in range(n)]) >= max(10, n / 2)])
    for n in range(6, 10):
        plant(n, [[True] * n])
    df, bench = table(spark, [(i, t) for _, i, t in docs]), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r.item_id, r.doc_id) for r in got} == {(k, i) for k, i, _ in docs} and len(got) == len(docs)
    near = [(k, " ".join(t.split()[:-1])) for k, t in items[-4:]]
    assert decontaminate.contaminated(table(spark, near), bench).count() == 0


def test_contaminated_awkward(spark, monkeypatch):
    """A very long item in several blocks, null ids, repeated rows and items, and a very long text."""
    monkeypatch.setattr(decontaminate, "ITEM_PART", 3000)
    rng = random.Random(21)
    long, short = words(rng, 20_000, 10**6), words(rng, 30, 10**6)
    items = [(1, long), (1, long), (2, short), (2, "other " + short), (None, short)]
    docs = [(1, long), (1, long), (None, short), (None, short), (None, None), (5, words(rng, 30_000, 10**6) + " " + short), (6, " ".join(long.split()[9000:9300]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 20_000):
        got = sorted((r.doc_id or 0, r.item_id or 0, r.item_tokens, r.matched) for r in decontaminate.contaminated(table(spark, docs), bench, max_seeds=most).collect())
        assert {x[:2] for x in got} == {(0, 0), (0, 2), (1, 1), (5, 0), (5, 2), (6, 1)} and (1, 1, 20_000, 20_000) in got and len(got) == 6
    clean = decontaminate.drop_contaminated(table(spark, docs), bench).collect()
    assert [(r.doc_id, r.text) for r in clean] == [(None, None)]


# --- html


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a<p>b <b>c</b>d", "a\n\nb cd"),
        ("<ul><li>x<li>y<ol start=3><li>z<li>w</ol></ul>", "- x\n- y\n  3. z\n  4. w"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>both</table>", "Name       N\nlong name  1\nboth"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<div style='display: none'>no</div><span hidden>no</span>t<br>u<script>a<b</script>", "t\nu"),
        ("<head><title>no</title></head><body>yes &amp; &lt;x&gt;<!-- no -->", "yes & <x>"),
        ("<pre> k\n  l</pre>", " k\n  l"),
        ("<noscript>no</noscript>a </p> b", "a\n\nb"),
        ("<svg><title>no</title><defs><text>no</text></defs><text>seen</text><text>too</text></svg>x", "seen too x"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"),
        ("pick <select><option>no<option selected>this &amp; one<option>no</select> now", "pick this & one now"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<select><optgroup label=g><option>first<option>no</optgroup></select>", "first"),
        ("a<textarea>\nb &lt;\n c</textarea>d", "a b <\n c d"),
        ("<input value='in'><input type=hidden value=no><input type=submit value=Go><button>B</button>", "in Go B"),
        ("<video>no</video><object>no</object><iframe>no</iframe>z", "z"),
        ("<p>unclosed <b", "unclosed <b"),
        ("<dl><dt>T<dd>D</dl><img alt='pic'>", "T\n  D\n\npic"),
        ("plain", "plain"), ("", ""), (None, ""),
    ],
)
def test_visible_text(source, text):
    assert html_text.visible_text(source) == text


def test_html_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<p>a", 5, "t")], "page_id long, html string, id long, text string")
    assert [tuple(r) for r in html_text.extract_text(df).collect()] == [(1, "a")]


def test_html_deep_and_broken(spark):
    deep = "<div>" * 5000 + "end" + "</div>" * 10
    assert html_text.visible_text(deep) == "end"
    df = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, "t"), (2, "x" * 300_000, "t")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, len(r.text)) for r in html_text.extract_text(df).collect()) == [(0, 0), (1, 1), (1, 1), (2, 300_000)]
    assert html_text.extract_text(df.limit(0)).count() == 0


# --- licences


def test_alignment_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    words_ = "the quick brown fox jumps".split()
    assert license_scan.align(words_, ["x", *words_, "y"]) == [(i, i + 1) for i in range(5)]


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"]
    rng = random.Random(1)
    worn = " ".join(w if rng.random() > 0.1 else "foo" for w in mit.split())
    text = "intro " + mit + " between" * 300 + " " + worn + " tail " + mit + " " + mit + "\nReleased under the MIT License.\n"
    df = table(spark, [(1, text), (2, None), (3, ""), (4, "this software is not licensed to anyone " * 50), (5, "RELEASED under\nthe MIT license"), (5, "RELEASED under\nthe MIT license")])
    got = license_scan.find_licenses(df).collect()
    assert Counter((r.doc_id, r.license) for r in got) == {(1, "MIT"): 4, (1, "MIT line"): 1, (5, "MIT line"): 2}
    first = min((r for r in got if r.doc_id == 1), key=lambda r: r.start)
    assert text[first.start : first.stop].startswith("Permission is") and first.coverage == 1.0
    assert license_scan.find_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Released under the BSD License.", {"BSD line"}), ("Released under the MIT License.", {"MIT line"}), ("Released under the Zlib License.", set()),
        ("Licensed under CC BY 4.0.", {"CC-BY-4.0 line"}), ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0 line"}), ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0 line"}), ("Licensed under CC BY-NC-SA 4.0.", set()),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0 line"}), ("Licensed under the GNU General Public License, version 3.", {"GPL-3.0 line"}),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", {"LGPL-2.1 line"}), ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0 line"}),
        ("Licensed under the Apache License, Version 1.1.", set()), ("Licensed under the Apache License 2.0.", {"Apache-2.0 line"}), ("Licensed under the Mozilla Public License, Version 2.0.", {"MPL-2.0 line"}),
        *[(license_scan.TEMPLATES[n], {n}) for n in ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0 notice", "GPL-3.0 notice", "LGPL-2.1 notice", "LGPL-3.0 notice", "MPL-2.0 notice")],
    ],
)
def test_neighbouring_licenses_are_told_apart(text, names):
    assert {n for n, *_ in license_scan.Scanner().scan(f"some words before {text} and some after")} == names


def longest_common(a, b):
    """Length of the longest common subsequence, by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("wear", [0.05, 0.15, 0.24])
def test_licenses_recall_against_exhaustive_alignment(wear):
    """Copies worn by substituted, lost and inserted words, which the best alignment still covers, are found."""
    rng, scanner = random.Random(7), license_scan.Scanner()
    filler = [f"w{i}" for i in range(500)] + "the of and to in is with for this that software".split()
    pick = lambda n: [rng.choice(filler) for _ in range(rng.randrange(n))]
    planted = found = 0
    for name, words_ in scanner.templates.items():
        for wear_as in (lambda x: [rng.choice(filler)], lambda x: [], lambda x: [x, rng.choice(filler)]):
            for _ in range(8):
                copy = [y for x in words_ for y in (wear_as(x) if rng.random() < wear else [x])]
                if longest_common(words_, copy) >= license_scan.MIN_COVERAGE * len(words_) and scanner._told(scanner.telling[name], copy):
                    planted += 1
                    found += name in {x[0] for x in scanner.scan(" ".join(pick(300) + copy + pick(300)))}
    assert planted > 200 and found >= 0.98 * planted, (found, planted)


# --- language model


def test_lm_scores(spark, corpus):
    rows = [*corpus, *[(100 + k, t) for k, (_, t) in enumerate(corpus[:20])]]
    scored, model = lm_score.score_texts(table(spark, rows), block_bytes=3000, fragments=5)
    got = {r.doc_id: tuple(r)[1:] for r in scored.collect()}
    seqs = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    outside = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in seqs}
    c, b = Counter(), Counter()
    for i, s in seqs.items():
        if not outside[i]:
            c.update(s)
            b.update(zip([None, *s[:-1]], s))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (n, v)
    assert np.allclose(model.weights.sum(1), 1) and (model.weights[:, 1:] > 0).all()
    for i, s in seqs.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s)
        score = 0.0
        for h, w in zip([None, *s[:-1]], s):
            x = model.weights[min(math.frexp(c[h])[1], lm_score.BUCKETS - 1)]
            score += math.log10(x[0] * b[h, w] / max(c[h], 1) + x[1] * c[w] / n + x[2] / (v + 1))
        assert got[i][:4] == (outside[i], len(s), sum(c[w] > 0 for w in s), n)
        assert got[i][4:] == pytest.approx((base, score))


def test_weights_rise_in_likelihood():
    cells = np.array([(5 << 32) | (3 << 16) | 20, (5 << 32) | (0 << 16) | 20, (2 << 32) | (0 << 16) | 0], np.int64)
    w = lm_score.learn_weights(cells, np.array([900.0, 100.0, 50.0]), 1000)
    assert w[5, 0] > 0.7 and w[2, 2] > w[5, 2] and w[0, 0] == 0


def test_lm_scores_depend_on_no_partitions(spark, corpus):
    found = []
    for parts, blocks, fragments in ((2, 3000, 5), (17, 3000, 5), (3, 1 << 23, None)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        scored, model = lm_score.score_texts(table(spark, corpus), block_bytes=blocks, fragments=fragments)
        found.append((sorted(map(tuple, scored.collect())), model.weights.tolist()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2]


def test_lm_counts_beyond_32_bits():
    """Sums and hashes travel whole."""
    block = lambda i: (i, lm_score._joined([lm_score._squeezed(np.full(4, 0xFFFFFFFF, np.uint32)), lm_score._squeezed(np.zeros(2, np.uint32)), lm_score._gaps(np.array([7, 7 + (1 << 41)], np.uint64)), lm_score._gaps(np.array([1 << 63], np.uint64))]))
    rows = [block(i) for i in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 3, pa.int32()), pa.array([i for i, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["fragment", "block", "payload"])
    out = next(lm_score._count(iter([batch]))).to_pydict()
    assert lm_score._loosened(lm_score._parted(out["payload"][0])[0], np.int64).tolist() == [3 * 0xFFFFFFFF] * 4
    assert np.frombuffer(out["payload"][-1], np.int64).tolist() == [6 * 0xFFFFFFFF, 2, 6 * 0xFFFFFFFF]


def test_lm_awkward(spark):
    got = lm_score.score_texts(table(spark, AWKWARD))[0].collect()
    assert len(got) == 7  # the repeated row is one document
    assert {r.n_tokens for r in got if r.doc_id in (7, 8)} == {1}
    assert lm_score.score_texts(table(spark, []))[0].count() == 0


# --- tokens


@pytest.fixture(scope="module")
def machine():
    return sentencepiece_fst.Transducer(sentencepiece_fst.read_spec(sentencepiece_fst.model_bytes()))


def test_pieces_equal_the_library(machine):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    texts = ["", " ", "  ", "a\u2581b", "\u2581", " a", "\n\n", "é\U0001f600漢字xyz", "a" * 500, "     " * 7, "Released under the MIT License.", "\x00\x01"]
    texts += ["".join(rng.choice(["a", "b", " ", "\u2581", "the", "ing", "é", "漢", "\n", "\U0001f600", "."]) for _ in range(rng.randrange(30))) for _ in range(500)]
    for t in texts:
        ids = machine.encode(t)
        assert ids == sp.encode(t)
        assert machine.decode(ids) == sp.decode(ids) == t.replace("\u2581", " ")


def test_unigram_shortest_path():
    pieces = [("<unk>", 0.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("abc", -9.0), ("c", -1.0), ("\u2581", -1.5), ("\u2581a", -1.8)]
    spec = sentencepiece_fst.Spec(tuple(pieces), (2, 1, 1, 1, 1, 1, 1, 1), False, False, True, True)
    m = sentencepiece_fst.Transducer(spec)
    assert m.encode("abc") == [7, 2, 5] and m.encode("xx c") == [6, 0, 6, 5]

    def best(t):
        if not t:
            return 0.0
        return min((best(t[k:]) + (-m.scores[t[:k]] if t[:k] in m.scores else m.unknown_weight) for k in range(1, len(t) + 1) if t[:k] in m.scores or k == 1))

    rng = random.Random(3)
    for _ in range(60):
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        assert sum(weight for _, weight, _ in m._shortest(t)) == pytest.approx(best(t))


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize(("fallback", "prefix", "squeeze"), [(True, True, False), (True, False, True), (False, True, True), (False, False, False)])
def test_handmade_models_equal_the_library(kind, fallback, prefix, squeeze):
    """Unigram and BPE models put together here (none is trained): weights, fallback and normaliser against the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = random.Random(kind * 10 + fallback)
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, fallback
    n = m.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", prefix, squeeze, True
    m.trainer_spec.vocab_size = 0
    for piece, score, k in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{b:02X}>", 0, 6) for b in range(256 if fallback else 0)]]:
        m.pieces.add(piece=piece, score=score, type=k)
    known = ["\u2581", "a", "b", "c", "d", "\u00e9"]
    rank = 0
    for c in known:
        m.pieces.add(piece=c, score=-(100 + len(known)) if kind == 2 else -rng.uniform(4, 6), type=1)
    for _ in range(40):
        made = rng.choice(known) + rng.choice(known)
        if made not in known:
            known.append(made)
            rank += 1
            m.pieces.add(piece=made, score=-rank if kind == 2 else -rng.uniform(3, 9), type=1)
    data = m.SerializeToString()
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_fst.Transducer(sentencepiece_fst.read_spec(data))
    for _ in range(400):
        t = "".join(rng.choice("aaabbccd\u00e9  xy") for _ in range(rng.randrange(25)))
        assert own.encode(t) == sp.encode(t), t


def test_tokens_awkward(spark):
    got = sentencepiece_fst.encode_texts(table(spark, AWKWARD), sentencepiece_fst.model_bytes()).collect()
    assert len(got) == 7 and all(r.decoded == "" for r in got if not r.ids)
    assert {r.decoded for r in got if r.doc_id == 9} == {"x " * 5000}


# --- toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    bad = ["idiot", "moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 5 == 0
        w = words(rng, rng.randrange(20, 60)).split()
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ",", "."])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "...")]
    docs, marks = table(spark, rows), spark.createDataFrame([*labels, (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    test = [(got[i].predicted, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p and t for p, t in test) >= 0.9 * sum(t for _, t in test)
    assert sum(p and not t for p, t in test) <= 0.02 * len(test)
    clean = toxicity.drop_toxic(docs, model)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {i for i, r in got.items() if not r.predicted}


@pytest.mark.parametrize("per_class", [40, 150, 4000])
def test_toxicity_weights_follow_the_labels(spark, monkeypatch, per_class):
    """Sampled texts stand for all learning labels of their class, however many of them the sample holds."""
    labels = [(i, int(i % 10 == 0)) for i in range(1000)]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y, langs, ratio: seen.append((y, ratio)))
    toxicity.fit(table(spark, [(i, f"text {i}") for i, _ in labels]), spark.createDataFrame([*labels, *labels], "doc_id long, toxic int"), per_class=per_class)
    learn = [t for i, t in labels if zlib.crc32(str(i).encode()) % 5]
    y, ratio = seen[0]
    assert sum(y) == min(per_class, sum(learn)) and ratio * (len(y) - sum(y)) / sum(y) == pytest.approx((len(learn) - sum(learn)) / sum(learn))


def test_threshold_counts_errors_by_weight():
    logits, labels = np.array([0.0, 1.0, 2.0, 3.0, 4.0]), np.array([0, 1, 1, 0, 1])
    assert toxicity._threshold(logits, labels, 1.0) == 0.5 and toxicity._threshold(logits, labels, 9.0) == 3.5


def test_toxicity_learns_from_all_labelled_texts(spark):
    """Beyond the texts of the first part the weights, the languages and their letter pairs come from every learning text."""
    rng = random.Random(9)
    rows = [(i, words(rng, 30) + (" idiot" if i % 4 == 0 else ""), f"l{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    model, first = toxicity.fit(docs, marks, per_class=5), toxicity.fit(docs, marks.where("doc_id < 20"))
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert model.languages == sorted(r[2] for r in learn) and len(model.thresholds) == len(learn) and model.memory is None is first.memory
    for i, text, lang in learn:
        _, _, data, offsets = next(toxicity.text_chunks(pa.array([text])))
        n = toxicity._letters(data, offsets)[0] + 1
        assert abs(model.profile[:, model.languages.index(lang)] - np.log(n / n.sum())).max() < 1e-9
    again = toxicity.fit(docs.repartition(3), marks.repartition(2), per_class=5)
    assert abs(again.table - model.table).max() < 1e-3 and toxicity.score_toxicity(docs, model).count() == 60


def test_toxicity_states_follow_the_bytes_of_text(spark, monkeypatch):
    """Each task of a pass writes a state of 6 MB: there are as many as the texts need, whatever the session's partitions."""
    states, write = [], toxicity.durable

    def noted(df):
        out = write(df)
        states.extend([out.where("lang IS NULL").count()] if "sums" in out.columns else [])
        return out

    monkeypatch.setattr(toxicity, "durable", noted)
    docs = table(spark, [(i, f"word {i}" + " idiot" * (i % 4 == 0)) for i in range(60)])
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        toxicity.fit(docs, marks, per_class=5)
        assert states == [1] * toxicity.ROUNDS
        monkeypatch.setattr(toxicity, "PASS_BYTES", 300)
        toxicity.fit(docs, marks, per_class=5)
        assert states[-1] > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_toxicity_awkward(spark):
    none = toxicity.fit(table(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(table(spark, []), none).count() == 0
    assert len(toxicity.score_toxicity(table(spark, AWKWARD), none).collect()) == 7
    assert toxicity.drop_toxic(table(spark, AWKWARD), none).count() == len(AWKWARD)
