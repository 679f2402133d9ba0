"""Surrogates, syncmers, page differencing and license scans against plain versions."""

import hashlib
import itertools
import os
import random
import re
import struct
import time
from collections import Counter

import pytest
import xxhash
from graphsieve.llm import html_main, licenses, pii, syncmers
from graphsieve.llm.common import Scratch

from .awkward import frame, rows

KEY = b"test key"


# ------------------------------------------------------------------ personal data
def valid(digits):
    """With the check digit, found by trying all."""
    holds = lambda x: sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(x))) % 10 == 0
    return next(digits + c for c in "0123456789" if holds(digits + c))


def sample():
    rng = random.Random(3)
    out = []
    for i in range(60):
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        ip = ".".join(str(rng.randrange(1, 255)) for _ in range(4))
        out.append(f"Call +1 ({d(3)}) 555-{d(4)} {ip} or a{d(2)}@mail{d(1)}.example.com, card {valid(d(15))} {d(4)} {d(4)} {d(4)} {d(4)}. token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" SSN {d(3)}-{d(2)}-{d(4)}")
    return out


def test_formats():
    cases = {
        valid("478538059239113"): r"4\d{15}",
        "+1 (743) 555-3824": r"\+1 \(\d{3}\) \d{3}-\d{4}",
        "152.143.123.131": r"(?:\d{1,3}\.){3}\d{1,3}",
        "hein.19@mail5.example.com": r"[a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com",
        'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"': 'TOKEN = "[0-9A-F]{40}"',
        "00:1A:2b:3c:4d:5e": "(?:[0-9a-f]{2}:){5}[0-9a-f]{2}",
        "123-45-6789": r"\d{3}-\d{2}-\d{4}",
        "4111 1111 1111 1111": r"4\d{3} \d{4} \d{4} \d{4}",
        "10.1.2.3": r"10\.\d+\.\d+\.\d+",
    }
    for text, shape in cases.items():
        new, found = pii.replace(f"x {text} y", KEY)
        assert len(found) == 1 and re.fullmatch(f"x {shape} y", new) and text not in new, (text, new)
    assert pii.luhn("411111111111111") == 1
    new = pii.replace("4111111111111111", KEY)[0]
    assert pii.luhn(new[:-1]) == int(new[-1])
    iban = pii.replace("DE89370400440532013000", KEY)[0]
    assert iban[:2] == "DE" and pii._iban_check("DE", iban[4:]) == iban[2:4] and iban != "DE89370400440532013000"


def test_names_keep_gender_script_and_coreference():
    a = pii.replace("Mr. John Smith met Mrs Anna Smith. Mr Smith and г-жа Иванова left; MR is no name", KEY)[0]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+)\. Mr (\w+) and г-жа ([А-Яа-я]+) left; MR is no name", a)
    assert m and m[2] == m[4] == m[5] and "Smith" not in a and "Иванова" not in a
    assert m[1] in pii.GIVEN["m", "latin"] and m[3] in pii.GIVEN["f", "latin"]


def test_clean_texts_stay():
    for t in ("version 3.", "In 1998 it was 42 or 3.14", "a@b", "GNU General Public License, version 3.", "1.2.3", "12345678"):
        assert pii.replace(t, KEY)[0] == t


def test_addresses_after_signs_and_entities_across_lines():
    for before in ("-", "_", "...", "+", "%", "token=abcdefghijkl1\u00e9"):
        new, found = pii.replace(f"{before}john@x.com", KEY)
        assert found[-1].kind == "email" and "john" not in new and new.startswith(before[:1]), new
    assert [x.written for x in pii.entities("a@b.com1x@y.com")] == ["a@b.com", "1x@y.com"]
    for text, gone in {
        "dear Herr\nMueller,": ["Mueller"],
        "Mrs.\n\n Anna Smith": ["Anna", "Smith"],
        "Mrs. Anna\nSmith": ["Anna", "Smith"],
        "Mr\u00a0John Smith": ["John", "Smith"],
        "password:\n abcdefghijkl123": ["abcdefghijkl123"],
        "the password\n\n= 'abcdefghijkl123'": ["abcdefghijkl123"],
        "api_key\n:\nabcdefghijkl123": ["abcdefghijkl123"],
        "password: johnathansmith@x.com": ["johnathansmith@x.com"],
        "aa:bb:cc:dd:ee:ff\n1": ["aa:bb:cc:dd:ee:ff"],
    }.items():
        new, found = pii.replace(f"first\n{text}\nlast", KEY)
        assert [x.written for x in found] == gone and not any(g in new for g in gone), new
        assert new.count("\n") == text.count("\n") + 2


def test_permutations_are_bijections():
    assert len({pii.permute(i, 10, 10, KEY, "t") for i in range(100)}) == 100
    assert len({pii.permute_text(f"{i:03d}", "0123456789", KEY, "t") for i in range(1000)}) == 1000
    assert len({pii.by_class(f"ab{i:02d}", KEY, "t") for i in range(100)}) == 100


def test_replaces_everything_alike(spark, docs):
    texts = sample()
    data = [(i, t, *[None] * 17) for i, t in enumerate([*texts, *texts[:20], None, "", "no data"])]
    got = {r["doc_id"]: r for r in pii.replace_pii(frame(spark, data), KEY).collect()}
    assert len(got) == len(data)
    whole = {}
    for i, t in enumerate(texts):
        e = pii.entities(t)
        assert [x.kind for x in e] == ["phone", "ip", "email", "card", "card", "secret", "ssn"]
        assert got[i]["n_entities"] == 7 and not any(x.written in got[i]["text"] for x in e)
        for x, y in zip(e, pii.entities(got[i]["text"])):
            assert x.kind == y.kind and len(x.written) == len(y.written) or x.kind == "ip"
            whole.setdefault((x.kind, x.canon), set()).add(y.canon)
    assert all(len(v) == 1 for v in whole.values())
    for kind in ("phone", "ip", "email", "card"):
        new = [next(iter(v)) for (k, _), v in whole.items() if k == kind]
        assert len(set(new)) == len(new)
    assert all(got[60 + i]["text"] == got[i]["text"] for i in range(20))
    assert got[80]["text"] is None and got[81]["text"] == "" and got[82]["text"] == "no data"
    same = pii.replace_pii(docs, KEY, counts=False)
    assert same.columns == docs.columns and Counter(r["text"] for r in same.collect()) == Counter(r[1] for r in rows())


def test_collisions_are_resolved(spark):
    names = [f"n{i}" for i in range(120)]  # more names than the list has
    known = spark.createDataFrame([("given", n, "m") for n in names] + [("given", "felix", ""), ("surname", "a", "")], "kind string, canon string, gender string")
    rows_ = pii.resolve(known, KEY, Scratch(spark, "t")).collect()
    assert len(rows_) == 122 and any(r["attempt"] > 0 for r in rows_)
    given = [r["made"] for r in rows_ if r["kind"] == "given"]
    assert len(set(given)) == len(given) and all(r["made"] != r["canon"] for r in rows_)
    text = " ".join(f"Mr {chr(65 + i % 26)}{'abcdefgh'[i // 26]}xo Smith" for i in range(100))
    out = pii.replace_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).collect()[0]["text"]
    seen = re.findall(r"Mr (\w+) (\w+)", out)
    assert len({a for a, _ in seen}) == 100 and len({b for _, b in seen}) == 1


def test_a_class_that_is_full_of_real_ones():
    """All addresses of a /16, all short numbers of a country, all two-letter names of mail: one to one, none its own."""
    for kind, canons in (("ip", [f"192.168.{i >> 8}.{i & 255}" for i in range(65536)]), ("phone", [f"999|{i:04d}" for i in range(10_000)]), ("email", [f"{a}{b}@ab.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"])):
        made = [pii.surrogate(kind, c, KEY) for c in canons]
        assert len(set(made)) == len(canons) and not any(x == y for x, y in zip(made, canons))
        if kind != "email":
            assert set(made) == set(canons)


def test_secrets_of_two_alphabets_stay_apart():
    canons = ["".join(c) for c in itertools.product("0f", "ag", "bz", "1", repeat=1)]
    made = [pii.surrogate("secret", c, KEY) for c in canons]
    assert len(set(made)) == len(made) and all(bool(pii._HEX.fullmatch(x)) == bool(pii._HEX.fullmatch(y)) for x, y in zip(made, canons))


def test_bare_mentions_and_one_surrogate_a_given_name(spark):
    text = "Mr John Smith met Dr Maria Lopez. Smith said Lopez agreed. Maria left, john did not; Johnson and Mariah stayed. Mrs Maria Rose saw a rose. Rose is red"
    new, found = pii.replace(text, KEY)
    names = [x.written for x in found]
    assert names == ["John", "Smith", "Maria", "Lopez", "Smith", "Lopez", "Maria", "Maria", "Rose"]  # john and rose are words too
    assert not re.search(r"\b(Smith|Lopez|Maria)\b", new) and "Johnson and Mariah" in new and "Rose is red" in new
    m = re.fullmatch(r"Mr (\w+) (\w+) met Dr (\w+) (\w+)\. (\w+) said (\w+) agreed\. (\w+) left, john did not; Johnson and Mariah stayed\. Mrs (\w+) (\w+) saw a rose\. Rose is red", new)
    assert m[2] == m[5] and m[4] == m[6] and m[3] == m[7] == m[8] and m[3] in pii.GIVEN["f", "latin"]
    # most titles of all texts tell the gender, in each text
    data = [(1, "Mrs Alex Stone"), (2, "Mrs Alex Field"), (3, "Mr Alex Wood"), (4, "Dr Alex Hill"), (5, None)]
    out = [r["text"] for r in pii.replace_pii(spark.createDataFrame(data, "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    given = {t.split()[1] for t in out if t}
    assert len(given) == 1 and given <= set(pii.GIVEN["f", "latin"])


def test_long_numbers_that_are_no_cards():
    for t in ("ISBN 9780306406158 or 1716400000001 ms", "4785380592391138"):
        assert pii.replace(t, KEY)[0] == t, t
    assert valid("411111111111111") == "4111111111111111"


def test_brute_force_finds_the_same(spark):
    """Addresses, mail and cards by plain scanning of every substring between spaces."""
    rng = random.Random(11)
    octet = lambda x: x.isdigit() and str(int(x)) == x and int(x) < 256
    is_ip = lambda w: w.count(".") == 3 and all(octet(x) for x in w.split("."))
    is_mail = lambda w: re.fullmatch(r"[a-z0-9]+@[a-z]+\.[a-z]{2,}", w) is not None
    is_card = lambda w: w.isdigit() and 13 <= len(w) <= 19 and valid(w[:-1]) == w
    make = (lambda: ".".join(str(rng.randrange(0, 400)) for _ in range(rng.randrange(3, 6))), lambda: f"{'ab1'[rng.randrange(3)]}x@{'pq'[rng.randrange(2)]}z.{'c' * rng.randrange(1, 4)}", lambda: valid("".join(rng.choice("0123456789") for _ in range(rng.randrange(10, 20)))), lambda: "".join(rng.choice("0123456789") for _ in range(rng.randrange(13, 20))), lambda: "word")
    for _ in range(400):
        words = [make[rng.randrange(5)]() for _ in range(rng.randrange(0, 12))]
        text = " ".join(words)
        want = [("ip" if is_ip(w) else "email" if is_mail(w) else "card", w) for w in words if is_ip(w) or is_mail(w) or is_card(w)]
        assert [(x.kind, x.written) for x in pii.entities(text)] == want, text


# ------------------------------------------------------------------ syncmers
def xx(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<Q", v), seed=h)
    return h


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_sketch(text):
    h = [xx(w) for w in re.split(r"[\x20\x09-\x0D]+", text)]
    k, s = syncmers.K, syncmers.S
    found = []
    if len(h) >= k:
        inner = [xx(*h[i : i + s]) for i in range(len(h) - s + 1)]
        found = []
        for i in range(len(h) - k + 1):
            at = [signed(x) for x in inner[i : i + k - s + 1]]
            if min(at) in (at[0], at[-1]):
                found.append(xx(inner[i], inner[i + k - s]))
    if not found:  # too short, or no k-mer of it is closed
        a = 0
        for x in h:
            a = xx(a, x)
        found = [a]
    return sorted({x >> 32 for x in found})[: syncmers.SKETCH]


def test_edited_fingerprints(spark, docs):
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in data]
    want = Counter()
    for i, t in enumerate(texts):
        q, nxt = len(t) // 4, texts[(i + 1) % len(texts)]
        e = t[: len(t) - q] + nxt[:q]
        a, b, c = plain_sketch(t), plain_sketch(e), plain_sketch(nxt)
        hexa = lambda s: "".join(f"{x:08x}" for x in s)
        like = lambda x, y: 1.0 if x == y else len(set(sorted(set(x) | set(y))[: syncmers.SKETCH]) & set(x) & set(y)) / len(sorted(set(x) | set(y))[: syncmers.SKETCH])
        want[(data[i][0], len(t), hashlib.sha256(e.encode()).hexdigest(), hexa(a), hexa(b), round(like(a, b), 9), round(like(a, c), 9))] += 1
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in syncmers.edited_fingerprints(docs).collect())
    assert got == want


def test_texts_without_closed_syncmers_differ(spark):
    rng = random.Random(2)
    data = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (6, 7) for _ in range(60)]
    none = [t for t in data if not plain_sketch(t)]
    assert len(none) > 20 and len(data) - len(none) > 20
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r["text"]: r["fp"] for r in df.select("text", syncmers.sketch(syncmers.anchors(df["text"])).alias("fp")).collect()}
    assert all(len(got[t]) == 1 for t in none) and len({got[t][0] for t in none}) == len(none)
    assert all(got[t] == plain_sketch(t) for t in data if t not in none)
    rows_ = syncmers.edited_fingerprints(spark.createDataFrame(list(enumerate(none)), "doc_id long, text string")).collect()
    assert len(rows_) == len(none) and all(r["fingerprint"] and r["near_next"] == 0.0 and r["near_edited"] < 1.0 for r in rows_)


def test_anchors_match_by_position(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    a = spark.createDataFrame([(1, " ".join(words))], "a long, text string")
    b = spark.createDataFrame([(2, " ".join(["new", "words", "before"] + words[20:150] + ["after"]))], "b long, text string")
    rows_ = syncmers.shared_anchors(a, b, "a", "b").collect()
    assert len(rows_) > 30 and all(r["at_a"] - r["at_b"] == 17 for r in rows_)


def test_syncmers_run_no_python(spark, docs):
    plan = syncmers.edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_syncmers_small(spark, empty):
    assert syncmers.edited_fingerprints(empty).count() == 0
    one = syncmers.edited_fingerprints(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()


# ------------------------------------------------------------------ pages
def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines():
    rng = random.Random(3)
    for _ in range(800):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(15))] for _ in range(2))
        hit = [x for x, y in zip(a, html_main.common_lines(a, b)) if y]
        rest = iter(b)
        assert len(hit) == longest(a, b) and all(x in rest for x in hit)


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_lines_of():
    p = page("<nav><ul><li><a>Menu</a></li></ul></nav><!-- c <p>x</p> --><div class='ad'>Buy</div><article><header><h1>A &amp; B&nbsp; c</h1></header><p>one <b>t</b>wo<br>three<p>four</p><aside>side</aside><form>f</form><div class=\"post-comments\">said</div></article><footer>&copy;</footer>")
    assert [t for z, t in html_main.lines_of(p) if z == html_main.MAIN] == ["A & B c", "one two three", "four"]
    assert html_main.main_text(html_main.lines_of(p)) == "A & B c one two three four"
    for broken in ("", "<", "<p", "<p>a<", "<nav>m<article><p>kept", "<p a='x>y", "&#x41;&bogus;", "<script>never closed", "a<b", "<![CDATA[x]]>y", "</p></div>z"):
        html_main.lines_of(broken)
    assert html_main.main_text(html_main.lines_of("<nav>m<article><p>kept")) == "kept"
    assert html_main.main_text(html_main.lines_of("<p>1 < 2</p>")) == "1 < 2"


def test_containers_and_articles_are_no_chrome():
    text = lambda p: html_main.main_text(html_main.lines_of(p))
    for body in ("<body class='single comments-open'>", "<body class='has-sidebar search'>", "<body><div class='site no-sidebar'>", "<body><div id='content-sidebar'>"):
        for article in ("<article class='post no-comments'>", "<article id='share-12'>", "<main class='comments-closed'>"):
            assert text(f"<html>{body}{article}<p>kept</p>") == "kept", (body, article)
    inner = "<section id='related-work'><p>a</p></section><h2 id='search-trees'>b</h2><h2 id='search'>c</h2><div class='share-price'>d</div><p>e <math><mi>x</mi></math> f</p>"
    gone = "<div class='comments-area'>1</div><div class='post-comments'>2</div><div class='related-posts'>3</div><div id='sidebar'>4</div><div class='box social-share'>5</div><article class='comment'>6</article>"
    assert text(f"<article>{inner}{gone}<p>g</p></article>") == "a b c d e x f g"
    assert text("<div class='comments-area'><article class='x'>said</article></div><article>kept</article>") == "kept"
    assert text("<div class='has-sidebar'><p>kept</p><div class='left-sidebar'>gone</div></div>") == "kept"
    assert text("<html><head><title>t</title><meta charset=utf-8><body><p>kept</p>") == "kept"
    assert text("<html><head><title>t</title><link href=x><p>kept</p>") == "kept"
    assert text("<html><head>gone</head>kept") == "kept"
    assert text("<article><svg width=1 /><p>kept</p></article>") == "kept"


def test_extract(spark):
    shell = "<div>Site name</div><div>Latest news</div>{}<div>Contact us</div>"
    data = [
        (1, "http://a.org/news/1", page(shell.format("<p>First story</p>"))),
        (2, "https://www.a.org/news/2.html?x=1#top", page(shell.format("<p>Second story</p><p>More</p>"))),
        (3, "http://a.org/zoo/1", page(shell.format("<p>Other story</p>"))),
        (9, "http://a.org/zoo/2", page(shell.format("<p>Last story</p>"))),
        (4, "http://b.org/1", page("<div>Alone</div><p>Text</p>")),
        (5, "http://a.org/news/3", page("<div>Site name</div><article><p>Site name</p><p>Marked</p></article>")),
        (6, None, None),
        (7, "", ""),
        (8, "http://[bad", page("<article>x</article>")),
        (5, "http://a.org/news/3", page("<article>same id</article>")),
    ]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit("clash")).repartition(4)
    got = Counter((r["page_id"], r["url"], r["text"]) for r in html_main.extract_main(df).collect())
    want = {1: "First story", 2: "Second story More", 3: "Other story", 9: "Last story", 4: "Alone Text", 6: "", 7: "", 8: "x"}
    assert got == Counter([*((i, next(d[1] for d in data if d[0] == i), t) for i, t in want.items()), (5, "http://a.org/news/3", "Site name Marked"), (5, "http://a.org/news/3", "same id")])
    assert all(r["n_chars"] == len(r["text"]) for r in html_main.extract_main(df).collect())
    assert html_main.extract_main(df.limit(0)).count() == 0


def plain_pages(data):
    """Texts by differencing, said plainly: all pages of a host at once, longest common subsequences by a full table."""
    hosts = {}
    for k, (_, url, markup) in enumerate(data):
        host, path = html_main.host_and_path(url)
        hosts.setdefault(host, {}).setdefault(tuple(html_main.lines_of(markup or "")), []).append((path, k))
    out = [None] * len(data)

    def marks(a, b):
        a, b = ([(z == html_main.MAIN, t) for z, t in x] for x in (a, b))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        i, j, hit = len(a), len(b), set()
        while i and j:
            if t[i][j] == t[i - 1][j]:
                i -= 1
            elif t[i][j] == t[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                hit.add(i)
        return hit

    def weight(lines, zones, among=None):
        return sum(len(t) for i, (z, t) in enumerate(lines) if z in zones and (among is None or i in among))

    for pages in hosts.values():
        order = sorted((min(where)[0], html_main.Page.of(list(lines)).pack(), lines) for lines, where in pages.items())
        paths = [p for p, _, _ in order]
        assert len(set(paths)) == len(paths), "ties are broken by a hash that this version does not know"
        for k, (path, _, lines) in enumerate(order):
            near = [(-len(os.path.commonprefix([path, paths[i]])), abs(i - k), i) for i in range(max(0, k - 2), min(len(order), k + 3)) if i != k]
            near = [(marks(lines, order[i][2])) for _, _, i in sorted(near)]
            whole, article = weight(lines, (1, 2)), weight(lines, (2,))
            gone = set()
            if near:
                share = [weight(lines, (1, 2), m) / whole if whole else 0 for m in near]
                partner = next((m for m, x in zip(near, share) if x < 0.8), near[share.index(min(share))])
                gone = {i for i in partner if lines[i][0] != html_main.MAIN}
                others = [m for m in near if not article or weight(lines, (2,), m) / article < 0.5]
                if len(others) > 1 and any(lines[i][0] == html_main.MAIN for i in partner):
                    gone |= {i for i in set.intersection(*others) if lines[i][0] == html_main.MAIN}
            zone = html_main.MAIN if any(z == html_main.MAIN for z, _ in lines) else html_main.OPEN
            for _, j in pages[lines]:
                out[j] = " ".join(t for i, (z, t) in enumerate(lines) if z == zone and i not in gone)
    return out


def test_differencing_against_plain_version(spark):
    rng = random.Random(9)
    line = lambda k: f"<p>{' '.join(rng.choice('abcdefgh') * rng.randrange(1, 4) for _ in range(k))}</p>"
    data, removed = [], 0
    for host in range(12):
        head, tail, inside, quote = line(3), line(4) + line(2), line(2), line(9)
        for k in range(rng.choice((1, 2, 3, 9, 40))):
            own = "".join(line(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 8))) + (quote if k % 3 == 0 else "")
            body = head + (own if host % 2 else f"<article>{inside}{own}{inside}</article>") + tail
            data.append((len(data), f"https://h{host}.org/{rng.choice('xyz')}/{k:03d}.html", page(body)))
            if k % 5 == 0:  # the same page again, elsewhere, and nearly the same page
                data += [(len(data) + i, f"http://www.h{host}.org/{s}/{k:03d}", page(body)) for i, s in enumerate("aq")]
                data.append((len(data), f"http://h{host}.org/near/{k:03d}", page(body.replace("<p>", "<p>edited ", 1))))
    data += [(len(data), f"http://hot.org/p/{i % 3}", page(f"<p>menu</p><p>page {i % 3} of three</p>")) for i in range(3000)]
    rng.shuffle(data)
    data = [(k, url, markup) for k, (_, url, markup) in enumerate(data)]
    old = html_main.BLOCK
    html_main.BLOCK = 8  # many blocks, so that neighbours lie across their edges
    try:
        df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)
        got = {(r["page_id"], r["url"]): r for r in html_main.extract_main(df).collect()}
    finally:
        html_main.BLOCK = old
    want = plain_pages(data)
    assert len(got) == len(data)
    for (i, url, markup), text in zip(data, want):
        assert got[i, url]["text"] == text, url
        removed += text != html_main.main_text(html_main.lines_of(markup))
    assert removed > 3000


def test_repeated_pages_keep_their_text(spark):
    body = page("<p>Menu of the site</p><p>A story told once, at length.</p>")
    other = page("<p>Menu of the site</p><p>Something else entirely here.</p>")
    data = [(1, "http://a.org/s", body), (2, "http://a.org/s?x=1", body), (3, "http://a.org/t", body), (4, "http://a.org/z", other), (5, "http://b.org/s", body), (6, "http://b.org/s?y", body)]
    got = {r["page_id"]: r["text"] for r in html_main.extract_main(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    told = "A story told once, at length."
    assert got == {1: told, 2: told, 3: told, 4: "Something else entirely here.", 5: f"Menu of the site {told}", 6: f"Menu of the site {told}"}


def test_unclosed_elements_are_linear():
    began = time.perf_counter()
    assert len(html_main.lines_of("<nav><section>x" * 40_000)) > 0
    assert time.perf_counter() - began < 8


def test_differencing_reaches_the_tables(spark):
    """Every page is held against its partner: lines of markup's chrome, and without article tags the text's own neighbours."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert html_main.extract_main(pages).agg(F.sum("n_shared")).first()[0] > 0
    shell = F.regexp_replace(F.regexp_replace("html", "</?article>", ""), "<body>", "<body><div>Welcome to the site</div>")
    bare = html_main.extract_main(pages.withColumn("html", shell))
    alone = bare.where("n_shared = 0").count()
    assert alone < 60 and bare.where("text like '%Welcome to the site%'").count() == alone


def test_host_and_path():
    f = html_main.host_and_path
    assert f("HTTP://WWW.A.org/x/y.html?q=1#z") == ("a.org", "/x/y") and f("http://a.org/") == ("a.org", "") and f(None) == ("", "")


# ------------------------------------------------------------------ licenses
def license_words(text):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def plain_scan(text):
    s, out = license_words(text), set()
    for name, _, body in licenses.TEMPLATES:
        t = set(license_words(body))
        for start in range(0, max(1, len(s)), len(t)):
            if len(t & set(s[start : start + 2 * len(t)])) >= 0.75 * len(t):
                out.add(name)
    return ",".join(sorted(out))


def test_scan_against_all_windows(spark):
    rng = random.Random(6)
    filler = [f"f{i}" for i in range(500)]
    data = []
    for i in range(150):
        parts = [" ".join(rng.choice(filler) for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(0, 3)):
            name, _, body = rng.choice(licenses.TEMPLATES)
            w = body.split()
            if rng.random() < 0.5 and len(w) > 20:
                w[rng.randrange(len(w))] = "changed"
            if rng.random() < 0.2:
                w = w[: len(w) // 2]
            parts += [" ".join(w), " ".join(rng.choice(filler) for _ in range(rng.randrange(0, 60)))]
        data.append((i, "\n".join(parts), *[None] * 17))
    data += [(500, None, *[None] * 17), (501, "", *[None] * 17), (None, "Released under the MIT License.%%%", *[None] * 17), (1, "text", *[None] * 17)]
    df = frame(spark, data)
    got = Counter((r["doc_id"], r["templates"]) for r in licenses.scan_licenses(df).collect())
    own = Counter()
    shared = ",".join(sorted(set(plain_scan(data[1][1]).split(",")) - {""}))
    for r in data:
        own[(r[0], shared if r[0] == 1 else plain_scan(r[1]))] += 1
    assert got == own
    assert any("," in t for _, t in got)


def test_bands_guarantee():
    assert (1 - 0.75 / 2.25) ** licenses.bands_for() <= licenses.MISS


def test_license_limits(spark, empty, docs):
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(docs).count() == docs.count()
    with pytest.raises(ValueError):
        licenses.find_licenses(docs, templates=(("short", "X", "two words"),))
    plan = licenses.find_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
