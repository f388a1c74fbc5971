import hashlib
import os
import random
import re

import pytest

from codeloom.llm import chat, html_text

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[END]"]


def conversations(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "s") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, seg int, loss string")


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        out[c] = (len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_any_text(spark):
    rng = random.Random(1)
    bits = CONTROLS + [c[0] + "\\" + c[1:] for c in CONTROLS] + ["\\", "<", "[", "a", "é", "\n", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "[END]", "", None]), rng.choice([None, "", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(4)]])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (1, 0, "user", "same"), (1, 0, "user", "same"), (2, None, "assistant", "y")]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.format_conversations(conversations(spark, rows))).collect()}
    assert got == expected(rows)


def test_segments_and_flags(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "ok <\\/s>")]
    s = chat.format_conversations(conversations(spark, rows)).orderBy("seg").collect()
    assert "".join(r["text"] for r in s) == "<s>[INST]hi <\\/s>[/INST]ok <\\\\/s></s>"
    assert [r["text"] for r in s if r["loss"]] == ["ok <\\\\/s>"]
    c = chat.Codec(chat.Template())
    for text in ("</s>", "<\\/s>", "\\</s>", "[INST]][/INST]", "a<b[c", "<\\\\\\s>"):
        assert c.unescape(c.escape(text)) == text and not any(m in c.escape(text) for m in CONTROLS)


@pytest.mark.parametrize("roles, valid", [("ua", True), ("sua", True), ("uaua", True), ("u", False), ("a", False), ("uu", False), ("aus", False), ("us", False), ("uax", False), ("s", False)])
def test_state_machine(spark, roles, valid):
    name = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rows = [(1, k, name[r], "t") for k, r in enumerate(roles)]
    assert chat.read_back(chat.format_conversations(conversations(spark, rows))).first()["valid"] is valid


def test_declared_template(spark):
    t = chat.Template(begin="", turns={"user": ("<|u|>", "<|e|>", False), "assistant": ("<|a|>", "<|/a|>", True)}, other=("<|r|>", "<|n|>", "<|x|>"))
    rows = [(1, 0, "user", "<|e|>"), (1, 1, "assistant", "<|/a|> fine")]
    f = chat.format_conversations(conversations(spark, rows), t)
    r = chat.read_back(f, t).first()
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(rows)[1]


def test_the_extra_conversation_and_an_empty_table(spark):
    r = chat.chat_digest(conversations(spark, [(0, 0, "user", "x")]).where("false")).collect()
    assert [x["conv_id"] for x in r] == [-7] and r[0]["loss_chars"] == len(chat.EXTRA)


# ---- html


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Head</h1><p>One  two\n three &amp; &eacute;&#33;</p><p>x.</p></article><footer>&copy; me</footer></body></html>", "Head\n\nOne two three & é!\n\nx."),
        ("<article><p><b>Open<br><p>Next</article>", "Open\n\nNext"),
        ("<article><p>a &lt;b&gt; c<script>var t=\"</p>\";</script><style>p{}</style><!-- <p>no</p> --></p></article>", "a <b> c"),
        ('<main><p>Text here</p><div class="ad">Buy now it is cheap and good</div><section id="comments"><p>First! what a great long comment this is</p></section><aside>More</aside><form><p>Mail</p></form><p>End</p></main>', "Text here\n\nEnd"),
        ('<div class="cookie-notice"><p>We use cookies on this site for you</p></div><article><p>Body</p></article>', "Body"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut off <a href='x", "cut off"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("", ""),
        (None, ""),
        ("<nav>only a menu</nav>", ""),
        ("<article><ul><li>a<li>b</ul></article>", "a\n\nb"),
        ("<article><table><tr><td>x<td>y</table></article>", "x\n\ny"),
        ("<ARTICLE><P CLASS=lead>Upper</P></ARTICLE>", "Upper"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_pages_without_sections():
    para = "This is a longer paragraph of ordinary text that goes on for quite a few words so that it reads like the body of a page."
    page = f"<div><a href=a>One</a></div><div><a href=b>Two</a></div><div><p>{para}</p><p>{para}</p></div><div><a href=c>Contact us</a></div>"
    assert html_text.main_text(page) == para + "\n\n" + para


def test_tree_fits_its_table():
    t = html_text.labelled_table()
    assert (html_text.classify(html_text.tree(), t[:, :-1]) == t[:, -1]).mean() > 0.97


#: Pages that the tree never saw: what an extractor should return of them, and what it should not, in order.
UNSEEN = [
    "<nav><a href=1>{1}</a><a href=2>{1}</a></nav><div class='site-header'>{8}</div><main><h1>¶{5}</h1><p>¶{34}</p><p>¶{3}</p><div class='newsletter-signup'><p>{19}</p></div><p>¶{81}</p></main><div id=sidebar><p>{40}</p></div>",
    "<article class='post'><p>¶{2}</p><ul><li>¶<a href=q>{3}</a><li>¶{1}</ul><div class='read-more'><p>¶{45}</p></div><div class='tags'>¶{4}</div></article><section class='comment-list'><p>{55}</p><p>{5}</p></section>",
    "<div role=navigation>{6}</div><article><p>¶{90}</p><p>¶{9} <button>{1}</button></p></article><div role=contentinfo>{30}</div><p>{44}</p>",
    "<div><a href=1>{2}</a></div><div><a href=2>{1}</a></div><h1>¶{6}</h1><p>¶{62}</p><p>¶{25}</p><p>¶{44} <a href=3>{2}</a></p><div><a href=4>{3}</a></div><div><a href=5>{2}</a></div>",
    "<header>{14}</header><p>¶{33}</p><p>¶{72}</p><p>¶{28}</p><aside><p>{27}</p></aside><footer><p>{22}</p></footer>",
    "<div class='ad-slot'>{31}</div><div>¶{47}</div><div>¶{35}</div><div>¶{29}</div><p><a href=1>{9}</a></p><p>{2} <a href=2>{7}</a></p>",
    "<body class='has-sidebar'><article><header><h1>¶{4}</h1></header><p>¶{13}</p></article><form><p>{33}</p></form></body>",
    "<main><p>¶{6}</p></main><main><p>¶{7}</p></main><div class=gdpr>{60}</div>",
]


def test_precision_and_recall_on_unseen_pages():
    t = html_text.labelled_table(tuple(UNSEEN))
    got, want = html_text.classify(html_text.tree(), t[:, :-1]), t[:, -1] == 1
    assert (got & want).sum() >= 0.95 * got.sum() and (got & want).sum() >= 0.95 * want.sum() and len(t) > 40


def test_the_tree_looks_at_neighbours():
    seen = set()

    def walk(node):
        if isinstance(node, tuple):
            seen.add(html_text.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(html_text.tree())
    assert seen & {"words_before", "words_after"} and seen & {"links", "links_around", "links_before", "links_after"}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>Area <math><mi>x</mi></math> is given</p></article>", "Area x is given"),
        ("<article><p>Press <button>ok</button> now</p></article>", "Press ok now"),
        ("<main><p>a</p><div class='read-more'><p>b c</p></div><div class=tags>d</div><div class=toc>e</div></main>", "a\n\nb c\n\nd\n\ne"),
        ("<body class='with-sidebar'><article class='post no-comments'><p>x</p></article></body>", "x"),
        ("<article><p>x</p><article class=comment><p>a reader's words</p></article></article>", "x"),
    ],
)
def test_nothing_else_is_dropped(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_articles_of_the_tables():
    import html

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        inner = re.search("<article>(.*)</article>", page, re.S)[1]
        blocks = [re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(re.sub("</?b>", "", x).replace("<br>", " "))).strip(" ") for x in re.split("</?(?:p|h1)>", inner)]
        assert html_text.main_text(page) == "\n\n".join(x for x in blocks if x)


def test_table_in_table_out(spark):
    d = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<article><p>é x</p></article>", "t"), (1, "u", None, "t")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(d).collect()
    assert sorted(map(str, got)) == sorted(map(str, got)) and len(got) == 3
    assert {(r["page_id"], r["text"], r["n_chars"]) for r in got} == {(1, "", 0), (None, "é x", 3)}
    assert html_text.extract_text(d.where("false")).count() == 0


def test_odd_markup_is_linear():
    import time

    began = time.time()
    for page in ("<a '" * 20_000, "<" * 50_000, "<div>" * 20_000, "&" * 50_000, "<!--" * 20_000, '<p class="' + "a" * 100_000):
        html_text.main_text(page)
    assert time.time() - began < 20
