"""HTML extraction, chat formatting and the pipeline."""

import hashlib
import html
import json
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routewise.llm import chat, html_text, jaccard_join, langid, pii, quality_mil
from routewise.llm.common import table
from routewise.llm.queries import op5_html, op7_chat, queries

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ---- HTML ----

def test_html_query_equals_article_element(spark):
    """The pages mark their article; a plain reading of that element is the reference."""
    pages = {r["page_id"]: r["html"] for r in table(spark, SF01, "pages").collect()}
    got = op5_html(spark, SF01).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


WEIGHTS = {"p": 0.01, "/p": 0.01, "article": 0.1, "/article": 0.1, "li": 1.0, "/li": 1.0, "ul": 1.0, "/ul": 1.0, "div": 0.5, "/div": 0.5, "body": 1.0}


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("just words", "just words"),
    ("<body><nav><a>Home page of the site</a></nav><article><p>One two.</p><aside>Skip this long sidebar text</aside><p>x</p></article>"
     "<footer>foot words here</footer>", "One two.\nx"),
    ("<article><h1>T &amp; U</h1><p>a&nbsp;&#233;\n  b<b>c</b> d<br>e</p><script>var a='</p>';</script><form>mail <input></form></article>", "T & U\na é bc d\ne"),
    ("<article><p>text here</p><div class='comments'><p>nice post indeed my friend</p></div><div id=cookie-notice>we use them</div></article>", "text here"),
    ("<article><p>cut &am &amp off <a href='x", "cut &am & off"),
    ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
    ("<!-- x <p>no</p> --><p>yes</p><!-- open", "yes"),
    ("<ul><li><a>m</a></li><li><a>n</a></li></ul><p>the real text of this page is here</p><p>end</p>", "the real text of this page is here\nend"),
    ("<article><header><h1>Title</h1></header><p>body words</p></article>", "Title\nbody words"),
    ("<header>site name</header><main><p>body words</p></main>", "body words"),
    ("<article><p>roads, loads and adsorption</p><p class='lead'>kept</p></article>", "roads, loads and adsorption\nkept"),
    ("<div hidden>gone</div><p>here</p><P>UP</P>", "here\nUP"),
])
def test_html_cases(page, text):
    assert html_text.extract(page, WEIGHTS) == text


def test_html_scan_is_the_best_run():
    """The region equals the best of all runs."""
    import random
    rng = random.Random(0)
    for _ in range(60):
        parts = [rng.choice(["w ", "two words ", "<li>", "</li>", "<p>", "</p>", "<ul>"]) for _ in range(14)]
        page = "".join(parts)
        seq = html_text.tokens(page)
        value = [len(v.split()) if k == "text" else -WEIGHTS.get(v, 1.0) for k, v, _ in seq]
        best = max((sum(value[i:j]) for i in range(len(value)) for j in range(i + 1, len(value) + 1)), default=0)
        got = html_text.extract(page, WEIGHTS)
        if best <= 0:
            assert got == ""
        else:
            runs = [(i, j) for i in range(len(value)) for j in range(i + 1, len(value) + 1) if sum(value[i:j]) == pytest.approx(best)]
            words = [sum(len(v.split()) for k, v, _ in seq[i:j] if k == "text") for i, j in runs]
            assert len(got.split()) in words


def test_html_edges(spark):
    rows = [(1, None, "u"), (2, "", "u"), (2, "", "u"), (None, "<p>a b</p>", None), (5, "<p>" + "w " * 200000 + "</p>", "u")]
    pages = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, html string, url string, text string, n_chars int")
    weights = html_text.fit_weights(pages)
    got = {(r["page_id"], r["n_chars"]) for r in html_text.extract_pages(pages, weights, ["page_id", "url"]).collect()}
    assert got == {(1, 0), (2, 0), (None, 3), (5, 399999)}
    assert html_text.fit_weights(pages.limit(0)) == {} and html_text.extract_pages(pages.limit(0), {}, ["page_id"]).count() == 0


# ---- chat ----

HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "<<SYS>>\\<</SYS>>", "", "%0A[<", "a\nb\r\n", "<s", "\U0001F600$1\\$"]


def test_chat_round_trip(spark):
    rows = [(i, t, role, text) for i, role in enumerate(["user", "assistant", "odd\nrole<|im_end|>%", ""]) for t, text in enumerate(HOSTILE)]
    df = chat.format_turns(chat.turns_from_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in df.withColumn("back", chat.parse_formatted(F.col("formatted"))).collect():
        assert [(b["role"], b["text"]) for b in r["back"]] == [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert r["formatted"].count("<|im_start|>") == len(HOSTILE) and "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]
        spans = [r["formatted"][s["start"]:s["start"] + s["length"]] for s in r["loss_mask"]]
        assert [re.sub(r"(?s)\\(.)", r"\1", s) for s in spans] == (HOSTILE if r["conv_id"] == 1 else [])


def test_chat_layouts(spark):
    turns = [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]
    records = [{"prompt": "q", "response": "a"}, {"response": "a", "prompt": "q"}, {"question": "q", "answer": "a"}, {"instruction": "q", "input": "", "output": "a"},
               {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
               {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, '{"other": 1}'), (91, "not json"), (92, None), (93, '{"messages": []}')]
    got = {r["i"]: r for r in chat.turns_from_json(spark.createDataFrame(rows, "i int, record string")).collect()}
    for i in range(len(records)):
        assert [x.asDict() for x in got[i]["turns"]] == turns, records[i]
    assert got[0]["layout"] == got[1]["layout"] != got[2]["layout"]
    assert all(got[i]["turns"] is None for i in (90, 91, 92, 93))
    both = chat.turns_from_json(spark.createDataFrame([(1, json.dumps({"instruction": "do", "input": "this", "output": None}))], "i int, record string")).first()
    assert [x["text"] for x in both["turns"]] == ["do\n\nthis", ""]


def test_chat_mixed_lists_are_no_known_layout(spark):
    """The fingerprint covers all elements: texts under other keys are never emptied silently."""
    plain = {"role": "user", "content": "q"}
    rest = [{"from": "gpt", "value": "a"}, {"role": "assistant", "parts": ["a"]}, "a", None, {"role": "assistant", "content": "a", "name": "n"}]
    rows = [(i, json.dumps({"messages": [plain, x]})) for i, x in enumerate(rest)] + [(9, json.dumps({"messages": [plain, {"content": "a", "role": "assistant"}]}))]
    got = {r["i"]: r for r in chat.turns_from_json(spark.createDataFrame(rows, "i int, record string")).collect()}
    assert [x["text"] for x in got[9]["turns"]] == ["q", "a"]
    assert all(got[i]["turns"] is None and got[i]["layout"] != got[9]["layout"] for i in range(len(rest)))


def test_chat_rows_mapping_is_looked_up_by_fingerprint(spark, monkeypatch):
    monkeypatch.setitem(chat.MAPPINGS, ("at", "body", "conv_id", "who"), {"rows": ("conv_id", "at", "who", "body")})
    a = spark.createDataFrame([(1, 0, "user", "q", 5)], "conv_id long, turn long, role string, text string, extra int")
    b = spark.createDataFrame([(1, "q", "user", 0)], "conv_id long, body string, who string, at long")
    got = [chat.turns_from_rows(x).first() for x in (a, b)]
    assert got[0]["turns"] == got[1]["turns"] and got[0]["layout"] != got[1]["layout"]
    assert [chat.mapping_of_rows(x)[0] for x in (a, b)] == [r["layout"] for r in got]


def test_chat_query_digests(spark):
    rows = [r.asDict() for r in table(spark, SF001, "conversations").collect()]
    rows += [{"conv_id": -7, "turn": t, "role": role, "text": "</s>[INST] ok [/INST]"} for t, role in enumerate(["user", "assistant"])]
    by = {}
    for r in sorted(rows, key=lambda r: r["turn"]):
        by.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = op7_chat(spark, SF001).collect()
    assert {r["conv_id"] for r in got} == set(by)
    for r in got:
        turns = by[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_runs_no_python(spark):
    plan = op7_chat(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (None, 0, "assistant", "x"), (2, None, "assistant", "y" * 100000)]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, layout int, formatted string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(chat.turns_from_rows(df))).collect()}
    assert got[1]["n_turns"] == 4 and got[2]["loss_chars"] == 100000 and got[None]["loss_chars"] == 1
    assert chat.digest(chat.format_turns(chat.turns_from_rows(df.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat.turns_from_rows(df.drop("role"))


# ---- pipeline ----

def test_pipeline_stages(spark):
    """Every stage against what its operator says about its own input."""
    docs = table(spark, SF01, "documents").cache()
    labels = table(spark, SF01, "labels")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    good = stages["quality classifier"](spark, docs, SF01).cache()
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = rows(good)
    assert sum(i in kept for i, q in marked.items() if q) >= 0.99 * sum(marked.values())
    assert sum(i in kept for i, q in marked.items() if not q) <= 0.05 * sum(not q for q in marked.values())
    assert good.columns == docs.columns
    lang = stages["language id"](spark, good, SF01).cache()
    assert set(rows(lang)) == set(kept) and lang.columns == docs.columns
    noise = lang.limit(1).select(F.lit(-5).cast("long").alias("doc_id"), F.lit("1234 !!").alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    assert -5 not in rows(stages["language id"](spark, lang.unionByName(noise), SF01))
    one = stages["near duplicates"](spark, lang, SF01).cache()
    groups = {}
    for r in jaccard_join.join(lang).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert set(rows(one)) == {min(g) for g in groups.values()} and len(groups) < len(rows(lang))
    clean = rows(stages["pii"](spark, one, SF01))
    assert set(clean) == set(rows(one))
    assert all(clean[i] == pii.pseudonymize(t)[0] for i, t in rows(one).items())


def test_language_stage_rejects_unlearned_languages(spark):
    docs = table(spark, SF01, "documents").select(*corpus_pipeline.COLUMNS).cache()
    fr = docs.where("lang = 'fr'")
    odd = ["Съешь ещё этих мягких французских булок", "中文文本例子在这里", "Pójdźże kiń tę chmurność w głąb flaszy, wszystko będzie dobrze", "xkcd qwrtz plmk vbnm zzxq"]
    clean = ["on", "a", "me", "de", "elle un", "is"]
    more = spark.createDataFrame([(-1 - i, t * (20 if i % 2 else 1), None, "s", 1) for i, t in enumerate(odd)] + [(-101 - i, t, None, "s", 1) for i, t in enumerate(clean)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(more), SF01).select("doc_id").collect()}
    assert not {-1, -2, -3, -4} & kept and {-101 - i for i in range(len(clean))} <= kept
    without = docs.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    assert corpus_pipeline.language(spark, without, SF01).join(fr.select("doc_id"), "doc_id", "left_semi").count() <= 0.02 * fr.count()


def test_near_duplicates_are_chosen_by_row(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"u{i}" for i in range(60))
    rows = [(5, words), (7, words + " end"), (5, other), (3, other + " end"), (None, third), (None, third + " end"), (9, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"][:2]) for r in corpus_pipeline.near_duplicates(spark, docs, SF01).collect())
    assert got == [(0, "u0"), (3, "v0"), (5, "w0"), (9, "al")]


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SF001).collect()
    assert got and {"doc_id", "sequence_id", "offset"} <= set(got[0].asDict())


def test_pipeline_edges(spark, edge_docs):
    docs = edge_docs.select(*corpus_pipeline.COLUMNS).withColumn("lang", F.when(F.col("doc_id") > 4, "en"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        assert out.count() <= docs.count() or name == "packing"
        assert stage(spark, docs.limit(0), SF001).count() == 0
    one = corpus_pipeline.near_duplicates(spark, docs, SF001)
    assert one.where("doc_id = 4").count() == 1 and one.where("doc_id is null").count() == 1


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 14))


@pytest.mark.parametrize("attr", ["style='overflow:hidden'", "title='the hidden cost'", "data-id='menu-3'", "class='content no-sidebar'", "id=page class='site has-sidebar'",
                                  "class='post-with-comments'", "id=discussion", "class='sidebar main-text'"])
def test_html_wrappers_keep_their_text(attr):
    page = f"<body><div {attr}><p>The text of this page is in the wrapper.</p><p>Here is <a href='/hidden-gems'>a link</a> too.</p></div><p>foot</p></body>"
    assert html_text.extract(page, WEIGHTS).startswith("The text of this page is in the wrapper.\nHere is a link too.")
    assert "gone" not in html_text.extract(f"<p>one two three four</p><div {attr} HIDDEN><p>gone</p></div>", WEIGHTS)


def test_html_named_parts_of_an_article_stay():
    page = "<body><h1>Title</h1><p>one two three four five six</p><section id='discussion'><p>we discuss it</p></section></body>"
    assert html_text.extract(page, WEIGHTS).endswith("four five six\nwe discuss it")


def test_html_section_costs_are_learned(spark):
    rows = [(i, f"<body><article><div class='promo'><p>{'good words ' * 30}</p></div></article><div class='related'><p>{'other words ' * 30}</p></div></body>") for i in range(3)]
    weights = html_text.fit_weights(spark.createDataFrame(rows, "page_id long, html string"))
    assert weights["class promo"] < 1 < weights["class related"]
    page = "<p>one two three four five</p><div class={}><p>six seven</p></div><p>eight nine</p>"
    w = WEIGHTS | {k: v for k, v in weights.items() if k.startswith("class ")}
    assert html_text.extract(page.format("promo"), w) == "one two three four five\nsix seven\neight nine"
    assert html_text.extract(page.format("related"), w) == "one two three four five\neight nine"


@pytest.mark.parametrize("n", [1, 5, 20, 200])
def test_html_drops_comments_of_any_length(n):
    """Comments go even where they hold most of the page's words; a wrapper that only names them stays."""
    comments = "".join(f"<div class='comment'><p>Great post number {i}, thanks for sharing this with all of us</p></div>" for i in range(n))
    body = "Only eleven words are in this article, no more than that."
    for page in (f"<body><nav>a b</nav><article><p>{body}</p></article><div class='comments'>{comments}</div></body>",
                 f"<body><div><h1>T</h1><p>{body}</p></div><section id='comments'>{comments}</section></body>"):
        text = html_text.extract(page, {})
        assert body in text and "Great post" not in text
    wrapped = html_text.extract(f"<body><div class='comments-page'><h1>T</h1><p>{body * 9}</p></div></body>", {})
    assert body in wrapped
