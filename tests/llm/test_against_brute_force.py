"""Every operator against a plain restatement of its contract, on given rows and on hand-made ones."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from acacia.llm import decontaminate, licenses, mixing, pages, pii, repeats, simhash, topk, toxicity, urls
from tests.conftest import SMALL
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `_N_Words` string, Digest int, copies int"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(got, want):
    assert got == sorted(want, key=repr)


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs, [tuple(r) for r in docs.select("doc_id", "text").collect()]


LONG = " ".join(f"w{i % 700}" for i in range(30_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten eleven twelve"
ODD = [
    (1, None), (None, None), (None, "Null id. " + PASSAGE), (2, ""), (3, " \t\n"), (4, PASSAGE), (4, PASSAGE), (5, PASSAGE.upper() + " tail"), (6, "x " * 400), (7, LONG), (8, LONG + " end"),
    (9, "MIT License and the Apache License; cc-by CC  BY, GNU General\nPublic License. MIT MIT license"), (10, "Ärger über straße 東京 mit license"), (11, "one"), (12, "a@b.c@d.e 1.2.3.4.5.6.7.8 +1 (555) 123-4567 4111 1111 1111 1111 300.1.1.1"),
    (13, "é" * 3000 + "@x.y 0000000001.1.1.1"), (14, "K" * 50_000), (15, "1" * 20_000), (16, "password = hunter2hunter2 and token: abc"), (17, "a b a b " * 60),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None, "x", 1, 2) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# 1


COLUMNS_1 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_given(spark, given):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    same(rows_of(entry.queries()["op1_decontamination"](spark, SMALL), *COLUMNS_1), brute.contamination(given[1], items))


@pytest.mark.parametrize("block", [1 << 22, 60])
def test_decontamination_odd(spark, odd, none, block, monkeypatch):
    monkeypatch.setattr(decontaminate.scanned, "__defaults__", (None, 13, block))
    items = [(1, PASSAGE), (2, "MIT license"), (2, "one"), (3, None), (4, " ,"), (None, "tail"), (5, "alpha beta " * 9), (5, "x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    same(rows_of(decontaminate.report(odd, benchmark), *COLUMNS_1), brute.contamination(ODD, items))
    kept = decontaminate.clean(odd, benchmark)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not r[5] for r in brute.contamination(ODD, items))
    same(rows_of(decontaminate.report(odd, benchmark.limit(0)), *COLUMNS_1), brute.contamination(ODD, []))
    assert decontaminate.report(none, benchmark).count() == 0


def test_fm_index_finds_every_occurrence():
    rnd = random.Random(4)
    import numpy as np

    text = np.array([rnd.choice([0, 1, 2, 3]) for _ in range(400)] + [0])
    index = decontaminate.FMIndex(text, 3)
    phrases = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])
    low, high = index.search(phrases, np.full(27, 3))
    for p, a, b in zip(phrases.tolist(), low, high):
        want = [i for i in range(len(text) - 2) if text[i : i + 3].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# 2


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    scored = toxicity.scored(docs, toxicity.fit(docs, train)).join(test, "doc_id").select("rejected", "toxic").collect()
    right = [sum(r.rejected == bool(r.toxic) for r in scored if r.toxic == y) / sum(r.toxic == y for r in scored) for y in (0, 1)]
    assert right[0] > 0.94 and right[1] > 0.85


def test_toxicity_grades_and_odd_rows(spark, odd, none):
    texts = [(i, ("awful " * (i % 5 + 1) if i % 2 else "") + f"plain words here {i % 7}") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert all(out[i].rejected == bool(i % 2) for i in range(200))
    assert model.thresholds == sorted(model.thresholds) and out[9].severity > out[1].severity > out[5].severity
    kept = toxicity.clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD) and toxicity.scored(odd, model).count() == len(ODD)
    assert toxicity.clean(none, model).count() == 0 and toxicity.scored(none, model).count() == 0
    blank = toxicity.fit(docs, labels.limit(0))
    assert toxicity.scored(odd, blank).where("rejected or severity > 0").count() == 0


# 3


COLUMNS_3 = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_licenses(spark, given, odd, none):
    same(rows_of(licenses.scan(given[0]), *COLUMNS_3), brute.licenses(given[1], licenses.BASE))
    same(rows_of(licenses.scan(odd), *COLUMNS_3), brute.licenses(ODD, licenses.BASE))
    assert licenses.scan(none).count() == 0


def test_labels_and_scores(spark, given):
    rnd = random.Random(12)
    templates = [(p, x, True) for p, x in licenses.BASE] + [(p, x, False) for p, x in licenses.NOTICES]
    rows = list(given[1][:40]) + [(1000 + i, t) for i, (_, t) in enumerate(ODD)]
    for i in range(150):
        words = []
        for _ in range(rnd.randint(1, 3)):
            p = rnd.choice(templates)[0].split()
            p = [x for x in p if rnd.random() > 0.08 * rnd.randrange(3)]
            for _ in range(rnd.randrange(4)):
                p.insert(rnd.randrange(len(p) + 1), rnd.choice(["of", "the", "software", "really"]))
            words += p + [rnd.choice(["and", "the", "license"])] * rnd.randint(0, 30)
        rows.append((2000 + i, " ".join(words)))
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = {i: brute.notices(t, templates) for i, t in rows if i is not None}
    assert len(out) == len(rows) and sum(v[1] == 1.0 for v in want.values()) > 20 and sum(0.8 <= v[1] < 1 for v in want.values()) > 5
    for r in out:
        if r.doc_id is not None and sum(i == r.doc_id for i, _ in rows) == 1:
            assert (r.doc_id, r.labels, r.score) == (r.doc_id, want[r.doc_id][0], pytest.approx(want[r.doc_id][1]))


def test_changed_notice_is_found(spark):
    words = licenses.NOTICES[0][0].split()
    text = "before " + " ".join(words[:8] + ["really"] + words[8:12] + words[13:]) + " after"
    r = licenses.scan(spark.createDataFrame([(1, text), (2, " ".join(reversed(words)))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].labels == "mit" and r[0].n_base == 0 and 0.8 <= r[0].score < 1 and (r[1].labels, r[1].score) == ("", 0.0)


# 4


def test_personal_data(spark, given, odd, none):
    for docs, rows in ((given[0], given[1]), (odd, ODD)):
        out = pii.report(docs, pii.fit(docs)).collect()
        want = []
        for doc, t in rows:
            spans = brute.personal(t or "")
            want.append((doc, *[sum(s[0] == k for s in spans) for k in pii.BASE_KINDS], brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
        same(sorted((tuple(r)[:6] for r in out), key=repr), want)
        for r in out:
            kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
            assert [k for k in kinds if k in pii.BASE_KINDS] == sum(([k] * r[f"n_{k}"] for k in pii.BASE_KINDS), [])
    assert pii.report(none, pii.fit(none)).count() == 0


def test_secrets_join_base_spans_and_redaction(odd):
    weights = pii.fit(odd)
    out = {r.doc_id: r.spans for r in pii.report(odd, weights).collect()}
    assert out[16] == "secret:11:25"
    kept = {r.doc_id: r for r in pii.redacted(odd, weights).collect()}
    assert kept[16].text == "password = [SECRET] and token: abc" and kept[12].text.startswith("[EMAIL]@d.e [IP].[IP] ") and kept[4].text == PASSAGE


def test_long_secrets_go_whole(spark):
    secret = "eyJ0" + "aB3._-xY" * 250
    docs = spark.createDataFrame([(i, f"the token: {secret} and more", 0) for i in range(20)], "doc_id long, text string, n_chars int")
    weights = pii.fit(docs)
    assert {r.spans for r in pii.report(docs, weights).collect()} == {f"secret:11:{11 + len(secret)}"}
    assert {r.text for r in pii.redacted(docs, weights).collect()} == {"the token: [SECRET] and more"}


def planted(n, seed):
    """Texts with personal data of the method's own kinds and with what only looks like it; and the spans that are meant."""
    rnd = random.Random(seed)
    filler = "the river runs past old mills and fields where nothing much happens on most days".split()

    def iban(right):
        body = "".join(str(rnd.randrange(10)) for _ in range(18))
        check = 98 - int(body + "131400") % 97  # DE and two zeros
        return f"DE{check if right else (check + 5) % 90 + 2:02d}{body}"

    def secret():
        return "".join(rnd.choice("abcdef0123456789") for _ in range(rnd.randint(12, 400)))

    makers = [
        (True, "secret", lambda: (rnd.choice(["api_key = ", "token: ", "password=", "secret = "]), secret() + "7")), (False, "secret", lambda: ("the password: ", rnd.choice(["required", "forgotten", "changeme1", "example99x"]))),
        (True, "iban", lambda: (rnd.choice(["IBAN ", "pay to ", "account "]), iban(True))), (False, "iban", lambda: ("part ", iban(False))),
        (True, "name", lambda: (rnd.choice(["Mr. ", "Dr. ", "Frau ", "Herr "]), rnd.choice(["Anna Berg", "Peter Stone", "Maria Lange", "Thomas Weber"]))),
        (True, "ssn", lambda: ("social security number ", f"{rnd.randint(100, 599)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}")), (False, "ssn", lambda: ("model ", f"9{rnd.randint(10, 99)}-00-{rnd.randint(1000, 9999)}")),
    ]
    rows, spans = [], {}
    for i in range(n):
        text, spans[i] = "", set()
        for _ in range(rnd.randint(0, 4)):
            text += " ".join(rnd.choices(filler, k=rnd.randint(5, 20))) + " "
            right, kind, make = rnd.choice(makers)
            before, value = make()
            text += before
            if right:
                spans[i].add(f"{kind}:{len(text)}:{len(text) + len(value)}")
            text += value + ", "
        rows.append((i, text + "end"))
    return rows, spans


def test_own_kinds_are_found(spark):
    docs = spark.createDataFrame(planted(600, 1)[0], "doc_id long, text string")
    rows, want = planted(400, 2)
    held_out = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {s for s in r.spans.split(",") if s.split(":")[0] in pii.OWN_KINDS} for r in pii.report(held_out, pii.fit(docs)).collect()}
    hit = sum(len(got[i] & want[i]) for i in want)
    assert hit / sum(map(len, want.values())) > 0.9 and hit / sum(map(len, got.values())) > 0.9


def test_spans_and_redaction_against_brute_force(spark, given):
    weights = pii.fit(given[0])
    for docs, rows in ((given[0], given[1]), (spark.createDataFrame(planted(60, 3)[0], "doc_id long, text string"), planted(60, 3)[0])):
        texts, out = dict(rows), {r.doc_id: r for r in pii.report(docs, weights).collect()}
        for r in pii.redacted(docs, weights).collect():
            spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in out[r.doc_id].spans.split(",") if s)]
            covered = [next((k for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])) if a <= i < b), None) for i in range(len(texts[r.doc_id] or ""))]
            want, at = "", 0
            while at < len(covered):
                if covered[at] is None:
                    want, at = want + texts[r.doc_id][at], at + 1
                    continue
                end = max(b for _, a, b in spans if a <= at < b)
                while any(a < end < b for _, a, b in spans):
                    end = max(b for _, a, b in spans if a < end < b)
                want, at = want + f"[{covered[at].upper()}]", end
            assert (r.text or "") == want


def test_reliability_estimates():
    import numpy as np

    rnd = np.random.default_rng(1)
    truth = rnd.random(5000) < 0.6
    votes = np.stack([np.where(rnd.random(5000) < r, truth, ~truth) * 2 - 1 for r in (0.95, 0.8, 0.6)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    posterior, table = pii.estimate(patterns, n.astype(float))
    assert table[1, 0, 2] == pytest.approx(0.95, abs=0.06) and table[1, 1, 2] == pytest.approx(0.8, abs=0.06)


# 5


def page(body, title="T"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>{body}</body></html>'


CASES = [
    (None, ""),
    ("", ""),
    ("no markup &amp; all", "no markup & all"),
    (page("<nav><a href='/'>Menu</a></nav><article><h1>A  title</h1><p>One<br>two <b>three</b> &lt;x&gt; &#233;&hellip;<p>Four</article><footer>f</footer>"), "A title\nOne two three <x> é…\nFour"),
    (page("<main><div class='cookie-notice'>We use</div><p>Kept</p><div class=ad>Buy</div><aside>s</aside><section id='comments'><p>hi</p></section><form>f</form></main><p>outside"), "Kept"),
    (page("<article><p>a</p><!-- c --><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>"), "a\nx\ny\n1\n2"),
    (page("<article><header><h1>H</h1></header><p>3 < 4 &bogus; <a title='>'>l</a></p></article>"), "H\n3 < 4 &bogus; l"),
]


def test_pages(spark):
    rows = [(i, f"https://h.example/{i}", html, "x") for i, (html, _) in enumerate(CASES)] + [(0, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, slot string")
    out = pages.main_text(df)
    want = [(i, f"https://h.example/{i}", t, len(t)) for i, (_, t) in enumerate(CASES)] + [(0, None, "", 0)]
    same(rows_of(out, "page_id", "url", "text", "n_chars"), want)
    assert pages.main_text(df.limit(0)).count() == 0


def test_pages_without_marks_use_the_template(spark):
    rows = [(i, f"http://t.example/{i}", page(f"<div class='top'><a href='/'>Home {i}</a></div><div class='body'><p>Story {i} {'long text ' * 20}</p></div><div class='end'>Fine print</div>")) for i in range(8)]
    out = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in out] == [f"Story {i} {'long text ' * 20}".strip() for i in range(8)]


def texts_of(spark, bodies, host="u.example"):
    rows = [(i, f"http://{host}/{i}", b if b.startswith("<!") else page(b)) for i, b in enumerate(bodies)]
    return [r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


STORY = "Story {} " + "long text " * 20


def test_template_text_goes_and_data_stays(spark):
    # The notice stands inside the article, and only its class of tokens tells it from the story.
    notice = "<div class='x'><section class='y'><p>Printed on recycled paper by the same people.</p></section></div>"
    bodies = [f"<article><p>{STORY.format(i)}</p>{notice}<p>End {i}</p></article>" for i in range(6)]
    assert texts_of(spark, bodies) == [f"{STORY.format(i).strip()}\nEnd {i}" for i in range(6)]
    # Copies of a page are no template.
    assert texts_of(spark, [f"<article><p>{STORY.format(0)}</p></article>"] * 4) == [STORY.format(0).strip()] * 4


def test_template_decides_before_an_article_elsewhere(spark):
    bodies = [f"<div class='teaser'><article><p>Teaser {i}</p></article></div><div class='text'><p>{STORY.format(i)}</p><p>More {i}</p></div>" for i in range(6)]
    assert texts_of(spark, bodies) == [f"{STORY.format(i).strip()}\nMore {i}" for i in range(6)]


def test_tokens_of_equal_vectors_are_one_class(spark):
    rows = [(i, f"http://c.example/{i}", page(f"<div><p>{i}</p></div>" + "<ul><li><b>x</b></ul>" * (i % 3 + 1))) for i in range(6)]
    profile = pages.vectors(spark.createDataFrame(rows, "page_id long, url string, html string"))
    classes = {}
    for r in pages.template(profile).where("block = 0").collect():
        classes.setdefault((r.pages, r.total, r.vector), set()).add(r.token)
    ul = {"/html/body/ul", "/html/body/ul/li", "/html/body/ul/li/b"}
    assert ul in classes.values() and any({"/html/body", "/html/body/div"} <= c and not c & ul for c in classes.values())


@pytest.mark.parametrize("copies", [1, 5])
def test_parts_of_class_names_never_take_the_page(spark, copies):
    def whole(i, attributes, inner):
        return page("BODY").replace("<body>BODY", f"<body{attributes}>{inner}")

    kept = [
        lambda i: whole(i, " class='has-sidebar'", f"<article><p>{STORY.format(i)}</p></article>"),
        lambda i: whole(i, " class='no-comments'", f"<p>{STORY.format(i)}</p>"),
        lambda i: whole(i, "", f"<div class='layout-nav-left'><div class='nav'>Menu {i}</div><article><p>{STORY.format(i)}</p></article></div>"),
        lambda i: whole(i, "", f"<div class='layout-nav-left'><div class='nav'>Menu {i}</div><div class='text'><p>{STORY.format(i)}</p></div></div>"),
        lambda i: whole(i, "", f"<article class='post social'><p>{STORY.format(i)}</p></article>"),
        lambda i: whole(i, "", f"<main class='with-sidebar'><div class='cookie-notice'>We use {i}</div><p>{STORY.format(i)}</p></main>"),
        lambda i: whole(i, "", f"<div class='share-page'><main><p>{STORY.format(i)}</p><section class='comments'><article class='comment'>Me {i}</article></section></main></div>"),
    ]
    for n, make in enumerate(kept):
        assert (n, texts_of(spark, [make(i) for i in range(copies)])) == (n, [STORY.format(i).strip() for i in range(copies)])


KEEPS = [
    ('<article><p>a</p><p class="related-work">b</p><p class="social history">c</p><p id="comment-on-law">d</p><div id="ad-hoc-query">e</div></article>', "a\nb\nc\nd\ne"),
    ("<article><p>a</p><label>b</label> <object>c</object> <map>d</map></article>", "a\nb c d"),
    ("<main><h1>intro</h1><article><p>a</p></article></main>", "intro\na"),
    ("<main><nav>menu</nav><article><p>a</p></article><div class='x'>other</div></main>", "a"),
    ("<article class=x><p>a</p></article><aside>s</aside><article class=y><p>b</p></article>", "a\nb"),
    ("<article><div class=ad>x</div><p>a</p><div class='ad-slot-3'>y</div><section class='reader-comments'>z</section><p class='ad'>w</p></article>", "a"),
]


def test_names_that_only_begin_like_adverts_stay(spark):
    for copies in (1, 4):
        for body, want in KEEPS:
            bodies = [body.replace(">a<", f">a {i} {'long ' * 30}<").replace(">b<", f">b {i}<") for i in range(copies)]
            wants = [want.replace("a", f"a {i} {'long ' * 30}".strip(), 1) for i in range(copies)] if not want.startswith("intro") else [f"intro\na {i} {'long ' * 30}".strip() for i in range(copies)]
            wants = [w.replace("\nb", f"\nb {i}") for i, w in enumerate(wants)]
            if copies > 1:
                # What all pages of a host have is template text.
                got = texts_of(spark, bodies)
                assert all(set(g.split("\n")) <= set(w.split("\n")) and g.split("\n")[0].startswith(("a", "intro")) for g, w in zip(got, wants)), (body, got)
            else:
                assert texts_of(spark, bodies) == wants


def test_an_article_by_another_name_gives_the_same_text(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).collect()
    rows = [(r.page_id, "http://one.example/" + str(r.page_id), r.html) for r in given]
    renamed = [(i, u, h.replace("<article", "<div class='story'").replace("</article", "</div")) for i, u, h in rows]
    schema = "page_id long, url string, html string"
    texts = [{r.page_id: r.text for r in pages.main_text(spark.createDataFrame(x, schema)).collect()} for x in (rows, renamed)]
    assert texts[0] == texts[1]


def test_very_long_and_deep_pages():
    assert pages.extract(page("<article>" + "<p>word</p>" * 50_000 + "</article>")) == "\n".join(["word"] * 50_000)
    deep = pages._tokens(page("<div>" * 20_000 + "<p>x</p>" + "</b>" * 20_000))
    assert sum(len(path) for path, _ in deep) < 20_000 * 2 * pages.LONGEST_PATH
    assert pages.extract(page("<article>" + "<div class='q'>" * 5000 + "deep" + "</div>" * 5000 + "<p>end</p></article>")) == "deep\nend"


def test_pages_given(spark):
    import html
    import re

    for r in spark.read.parquet(f"{SMALL}/pages.parquet").join(pages.main_text(spark.read.parquet(f"{SMALL}/pages.parquet")).select("page_id", "text"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


# 6


def test_near_duplicates(spark, given, odd, none):
    columns = ("doc_id", "fingerprint", "component_id")
    same(rows_of(simhash.near_duplicates(given[0], tile=40), *columns), brute.near_duplicates(given[1]))
    want = brute.near_duplicates(ODD)
    same(rows_of(simhash.near_duplicates(odd), *columns), want)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for d, _, c in want if c is not None})
    assert simhash.near_duplicates(none).count() == 0


def test_forests_connect_what_links():
    import numpy as np

    rnd = random.Random(9)
    prints = [rnd.getrandbits(64) for _ in range(150)]
    prints += [p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for p in prints for _ in range(rnd.randrange(3))]
    a = np.array(sorted(set(prints)), np.uint64)

    def groups(edges):
        parent = {int(p): int(p) for p in a}

        def root(p):
            while parent[p] != p:
                p = parent[p]
            return p

        for x, y in edges:
            parent[root(int(x))] = root(int(y))
        return {p: root(p) for p in parent}

    want = groups((x, y) for x in a for y in a if (int(x) ^ int(y)).bit_count() <= 4)
    got = groups(simhash.linked(a, None, block=64).tolist())
    assert len(set(want.values())) == len(set(got.values())) and all((want[int(x)] == want[int(y)]) == (got[int(x)] == got[int(y)]) for x in a for y in a)


# 7


def test_mixing_given(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    columns = ("doc_id", "domain", "lang", "source", "tokens", "copies")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({mixing.oracle()})").fetchall()
    same(rows_of(entry.queries()["op7_mixing"](spark, SMALL), *columns), want)


def test_shortages_go_to_siblings_first(spark):
    # Under x, b is small: its share goes to a, and y is not touched. Then x is used up, and y gets the rest.
    rows = [("x", "a", "s", 100), ("x", "b", "s", 10), ("y", "a", "s", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")

    def plan(budget):
        out = mixing.budgets(leaves, budget / 1110, 1, {})
        return {(r.domain, r.lang): r.budget for r in out.collect()}

    assert plan(120) == {("x", "a"): 50, ("x", "b"): 10, ("y", "a"): 60}
    assert plan(600) == {("x", "a"): 100, ("x", "b"): 10, ("y", "a"): 490}


def test_mixing_odd(odd, none):
    out = mixing.selected(odd, fraction=1.5, epochs=2).collect()
    assert {r.domain for r in out} == {"d0"} and sum(r.tokens * r.copies for r in out) >= 1.5 * sum(len(brute.SPACED.findall(t or "")) for _, t in ODD)
    kept = mixing.mixed(odd)
    assert kept.columns == [*odd.columns, "copies_"] and mixing.selected(none).count() == 0 and mixing.mixed(none).count() == 0


# 8


def test_urls(spark):
    rows = [
        (1, "https://Sub.Example.COM/en/7abc?x#y", "sub.example.com", "/en/7abc", "example.com/en/7", "allow"), (2, "http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        (3, "x://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), (4, "http://a.net/de/8", "a.net", "/de/8", "net/de/", "allow"), (5, "http://m.example.net/de/8?q=/", "m.example.net", "/de/8", "example.net/de/8", "block"),
        (6, None, "", "", None, "allow"), (7, "example.com/en/7", "", "", None, "allow"), (8, "http://com/en/", "com", "/en/", "com/en/", "block"), (9, "http://org?/es/", "org", "", None, "allow"), (9, "http://org?/es/", "org", "", None, "allow"),
        (10, "http://ÄX.org/es/" + "z" * 5000, "Äx.org", "/es/" + "z" * 5000, "org/es/", "block"), (None, "a://b://c.org/es/", "b:", "//c.org/es/", None, "allow"),
    ]
    pages_ = spark.createDataFrame([(i, u, "r", "h") for i, u, *_ in rows], "page_id long, url string, rule string, host string")
    columns = ("page_id", "host", "path", "rule", "verdict")
    same(rows_of(urls.judged(pages_, urls.rule_table(spark)), *columns), [(i, *rest) for i, _, *rest in rows])
    assert urls.judged(pages_.limit(0), urls.rule_table(spark)).count() == 0
    assert urls.judged(pages_, urls.rule_table(spark).limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0


def test_urls_plan_is_native(spark):
    plan = urls.judged(spark.read.parquet(f"{SMALL}/pages.parquet"), urls.rule_table(spark))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


# 9


COLUMNS_9 = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_repeats(given, odd, none):
    same(rows_of(repeats.without_repeats(given[0].repartition(5)), *COLUMNS_9), brute.without_repeats(given[1]))
    same(rows_of(repeats.without_repeats(odd), *COLUMNS_9), brute.without_repeats(ODD))
    assert repeats.without_repeats(none).count() == 0


def test_repeats_of_few_words(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        words = [rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.choice([2, 3, 40]))]
        rows.append((i, " ".join(rnd.choice(words) if rnd.random() < 0.3 else words[0] for _ in range(rnd.randint(0, 150)))))
    for i in range(200, 300):
        a, b = (rnd.choice(rows)[1].split() for _ in range(2))
        rows.append((i, " ".join(a[rnd.randint(0, 50) :] + b[: rnd.randint(0, 90)])))
    same(rows_of(repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), *COLUMNS_9), brute.without_repeats(rows))


# 10


@pytest.mark.parametrize("block,bits", [(2048, 9), (2, 3)])
def test_top_k(spark, block, bits):
    rnd = random.Random(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rnd.randint(-3, 3) / 4 for _ in range(4)]) for i in range(350)] + [(100, [1.0]), (7, [2.0]), (400, None), (500, [nan, 0.0, 0.0, 0.0]), (501, [inf] * 4), (502, [None] * 4), (None, [1.0] * 4), (600, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    out = topk.top_k(df, df.where("vec_id % 100 = 0"), block=block, bits=bits)
    same(rows_of(out, "query_id", "rank", "vec_id", "score"), brute.top_k(rows))
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_huge_components(spark):
    df = spark.createDataFrame([(0, [3e30, 1.0]), (1, [-3e30, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    out = topk.top_k(df, df.where("vec_id = 0")).collect()
    assert [(r.vec_id, r["rank"]) for r in out] == [(2, 1), (1, 2)]


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, SMALL)
        if name == "toxicity":
            model = toxicity.fit(step, spark.read.parquet(f"{SMALL}/labels.parquet"))
            bad = toxicity.scored(step, model).where("rejected")
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in step.join(bad, "doc_id", "left_anti").collect())
        elif name == "near_duplicates":
            rows = [tuple(r) for r in step.select("doc_id", "text").collect()]
            assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in brute.near_duplicates(rows)})
        elif name == "decontamination":
            rows, items = ([tuple(r) for r in d.collect()] for d in (step.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")))
            assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in brute.contamination(rows, items) if not r[5])
        elif name == "personal_data":
            texts = {r.doc_id: r.text for r in step.collect()}
            for r in out.collect():
                assert r.n_chars == len(r.text) or r.text == texts[r.doc_id]
                assert all(texts[r.doc_id][a:b] not in r.text for k, a, b in brute.personal(texts[r.doc_id]) if k in ("email", "card"))
        if name != "mixing":
            assert out.columns == docs.columns
        step = out
        out = step
    assert corpus_pipeline.run(spark, SMALL).where(F.col("copies") < 1).count() == 0
