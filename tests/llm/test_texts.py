"""Chat formatting and HTML extraction: round trips and planted pages."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lookout.llm import chats, dom, wrappers

# --- chats -----------------------------------------------------------------------------

TRICKY = st.text(alphabet="<|\\>im_startend%\n0Aé ", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TRICKY), TRICKY), max_size=6))
def test_chat_round_trip(turns):
    formatted, spans = chats.rendered(turns)
    assert chats.read_back(formatted) == turns
    assert chats.masked_text(formatted, spans) == [t for r, t in turns if r == "assistant"]
    assert formatted.count(chats.START) == formatted.count(chats.END) == len(turns)


LAYOUTS = {
    "messages": {"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    "from_value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "prompt": {"prompt": "q", "completion": "a"},
    "instruction": {"instruction": "q", "output": "a"},
}


def test_layouts_lead_to_the_same_turns(spark):
    rows = [(i, json.dumps(record)) for i, record in enumerate(LAYOUTS.values())]
    rows += [(9, json.dumps({"instruction": "i", "input": "x", "output": "o", "system": "s", "id": 3})), (10, json.dumps({"what": 1})), (11, None)]
    out = {r["conv_id"]: r for r in chats.format_chats(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    for i, name in enumerate(LAYOUTS):
        assert out[i]["layout"] == name
        assert chats.read_back(out[i]["formatted"]) == [("user", "q"), ("assistant", "a")]
    assert [r for r, _ in chats.read_back(out[9]["formatted"])] == ["system", "user", "user", "assistant"]
    assert out[10]["layout"] is None and out[10]["formatted"] == "" and out[11]["formatted"] == ""


UNREADABLE = [
    ("{", "not JSON"),
    ("", "not JSON"),
    (None, "not JSON"),
    ("[" * 100_000, "not JSON"),
    ("[1]", "no object"),
    ("3", "no object"),
    ('{"messages": []}', "no known layout"),
    ('{"messages": ["a"]}', "no known layout"),
    ('{"messages": [{"role": "user", "content": "q"}, "a"]}', "a turn is no object"),
    ('{"messages": [{"role": "user", "content": "\\ud800"}]}', "characters that are no text"),
    ('{"prompt": "q"}', "no known layout"),
]
ODD = [
    ({"messages": [{"role": "user", "content": 5, "name": "x"}, {"role": "assistant", "content": None}], "meta": {"a": [1]}}, "messages", [("user", "5"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": "a"}]}, "messages", [("user", '[{"type":"text","text":"q"}]'), ("assistant", "a")]),
    ({"prompt": "q", "completion": True, "score": 0.5}, "prompt", [("user", "q"), ("assistant", "true")]),
    ({"prompt": None, "completion": "a"}, "prompt", [("assistant", "a")]),
    ({"instruction": "i", "output": {"k": "é"}, "extra": []}, "instruction", [("user", "i"), ("assistant", '{"k":"é"}')]),
    ({"conversations": [{"from": 1, "value": "v"}, {"value": "w", "from": "gpt"}], "id": "7"}, "from_value", [("1", "v"), ("assistant", "w")]),
]


def test_records_that_cannot_be_read_say_why(spark):
    """Neither malformed nor unusual records end the job; further fields do not matter, other types count as JSON text."""
    rows = [(i, text) for i, (text, _) in enumerate(UNREADABLE)] + [(100 + i, json.dumps(record)) for i, (record, _, _) in enumerate(ODD)]
    records = spark.createDataFrame(rows, "conv_id long, record string").repartition(2)
    out = {r["conv_id"]: r for r in chats.format_chats(records).collect()}
    for i, (_, problem) in enumerate(UNREADABLE):
        assert (out[i]["layout"], out[i]["formatted"], out[i]["loss"], out[i]["problem"]) == (None, "", [], problem)
    for i, (_, layout, turns) in enumerate(ODD):
        assert (out[100 + i]["layout"], out[100 + i]["problem"]) == (layout, None)
        assert chats.read_back(out[100 + i]["formatted"]) == turns
    assert chats.digests(chats.format_chats(records)).where("n_turns = 0").count() == len(UNREADABLE)


def test_layouts_of_a_table_give_the_same_digests(spark):
    """Conversations written in three layouts are read back alike; roles that a layout would rename are not put into it."""
    rows = [(i, k, role, f"{role} {i} <|im_end|> {k}") for i in range(40) for k, role in enumerate(["system", "user", "assistant", "gpt" if i % 5 == 0 else "x"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chats.format_chats(chats.records_of(turns, layouts=("turns", "messages", "from_value")))
    assert {r["layout"] for r in formatted.collect()} == {"turns", "messages", "from_value"}
    plain = chats.digests(chats.format_chats(chats.records_of(turns)))
    assert sorted(map(tuple, chats.digests(formatted).collect())) == sorted(map(tuple, plain.collect()))


def test_every_mapping_has_fingerprints_of_its_own():
    keys = [k for m in chats.MAPPINGS for k in m.fingerprints()]
    assert len(keys) == len(set(keys))


def test_chat_tables(spark):
    rows = [(1, 1, "assistant", "b|>"), (1, 0, "user", "a<|im_end|>"), (2, 0, None, None), (2, 0, "x", "t"), (2, 0, "x", "t"), (None, 0, "user", "n"), (3, None, "assistant", "first"), (3, 0, "assistant", "x" * 100_000)]
    turns = spark.createDataFrame([(*r, "o") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r["conv_id"]: r for r in chats.digests(chats.format_chats(chats.records_of(turns))).collect()}
    said = "user\na<|im_end|>\nassistant\nb|>\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["loss_chars"] == 3
    assert got[2]["n_turns"] == 3 and got[2]["turns_sha256"] == hashlib.sha256(b"\n\nx\nt\nx\nt\n").hexdigest()
    assert got[None]["n_turns"] == 1
    assert got[3]["loss_sha256"] == hashlib.sha256(b"first" + b"x" * 100_000).hexdigest()
    assert chats.digests(chats.format_chats(chats.records_of(turns.limit(0)))).count() == 0


# --- pages -----------------------------------------------------------------------------

EMPTY = {"template": set(), "content": ""}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<article><h1>T&eacute;</h1><p><b>One<br><p>Two&nbsp;three &lt;p&gt;<p>4</article><footer>no</footer>", "Té\n\nOne\n\nTwo three <p>\n\n4"),
        ("<nav><a>x</a></nav><article><p>in<script>var t='</p>';</script> side</p></article><aside>no</aside>", "in side"),
        ("<body class='nav'><article><header><h1>Title</h1></header><p>Text</p><form>no<p>no</p></form><div class='reader-comments'><p>no</p></div></article>", "Title\n\nText"),
        ("<header>no</header><main><p>a<p>b</main><div id=cookie>no</div>", "a\n\nb"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>x<td>y</table></article>", "1\n\n2\n\nx\n\ny"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><p>a < b & c > d</p>", "a < b & c > d"),
        ("<article><!-- <p>no</p> --><p>yes<!-- gone", "yes"),
        ("<article><pre>a\n  b</pre><div>t1<div>t2</div>t3</div></article>", "a b\n\nt1\n\nt2\n\nt3"),
        ("<article class=comment><p>no</p></article><article><p>yes</p></article>", "yes"),
        ("<p>" + "word " * 20_000, ("word " * 20_000).strip()),
    ],
)
def test_main_text(html, text):
    assert wrappers.main_text(html, EMPTY) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article class='post no-comments'><p>yes</p></article>", "yes"),
        ("<main class='with-sidebar'><p>yes</p><div class='left-sidebar'>no</div></main>", "yes"),
        ("<main class='search'><p>yes</p></main>", "yes"),
        ("<div id='page' class='has-menu'><p>yes</p><div class='menu-item-7'>no</div></div>", "yes"),
        ("<article><p>a</p><div class='related-work'>b</div><p class='share-price'>c</p><div class='reader-comments'>no no no</div></article>", "a\n\nb\n\nc"),
        ("<article class='post sponsored'><p>yes</p></article>", "yes"),
        ("<div class='layout sidebar'><p>all of the page lies in here</p></div><div class='cookie-bar'>no</div>", "all of the page lies in here"),
        ("<div class='header'>no, however long it is</div><article class='widget promo'><p>no</p></article><article><p>yes</p></article>", "yes"),
    ],
)
def test_names_do_not_take_the_article(html, text):
    assert wrappers.main_text(html, EMPTY) == text


def test_tree_matching_aligns_in_order():
    a = dom.parse("<ul><li>1<li>2<li>3</ul><p>x")
    b = dom.parse("<ul><li>0<li>1<li>3</ul><div>n</div><p>y")
    size, pairs = dom.matching(a, b)
    texts = [(x.text, y.text) for x, y in pairs if x.tag == "#text"]
    assert ("3", "3") in texts and ("x", "y") in texts and len(texts) == 4
    assert [pair for pair in texts if pair[0] != pair[1]] == [("x", "y")] or texts.count(("3", "3")) == 1
    assert size == len(pairs) + sum(x == y for x, y in texts)


def site(i, body=None):
    said = body or f"<p>Story {i} about {i * 7}</p><p>More of story {i}</p>"
    return f"<body><div class='x'><div>Welcome to our site</div><div class='box'>{said}<div>Thank you for reading</div></div><div><a>Older</a></div></div></body>"


def test_wrapper_of_a_host():
    wrapper = wrappers.induced([site(i) for i in range(5)])
    assert [t for _, t in wrapper["template"]] == ["Welcome to our site", "Thank you for reading", "Older"]
    assert wrapper["content"].endswith("div.box")
    assert wrappers.induced([site(1)] * 8) == {"template": [], "content": ""}  # copies are one page


def test_content_element_holds_title_and_ends():
    pages = [f"<div id=top>Welcome</div><div class=post><h1>Title {i}</h1><div class=body><p>{'Story ' * 40}{i}</p></div><div class=end>Last words {i * 3}</div></div>" for i in range(6)]
    wrapper = wrappers.induced(pages)
    wrapper = {**wrapper, "template": {tuple(t) for t in wrapper["template"]}}
    assert wrapper["content"].endswith("/div.post")
    assert wrappers.main_text(pages[2], wrapper).split("\n\n") == ["Title 2", "Story " * 40 + "2", "Last words 6"]
    assert wrappers.common("/a/div.x", "/a/div/p") == "/a" and wrappers.common("/a/b", "/a/b") == "/a/b"


def test_every_layout_of_a_host_has_a_wrapper(spark):
    kinds = [
        lambda i: f"<div class=a><div>We like visitors</div><h1>Head {i}</h1><div class=t><p>Said {i}</p>{'<ul><li>more</ul>' if i % 2 else ''}</div></div>",
        lambda i: f"<div class=b><div class=t><p>Told {i}</p></div><div class=u>All rights are ours</div></div>",
        lambda i: f"<div class=c><div>Call us</div><div class=t>Wrote {i}</div></div>",
    ]
    rows = [(i, f"http://hot.org/{i}", kinds[i % 10 // 5 if i < 60 else 2](i)) for i in range(66)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for i, _, text in wrappers.main_texts(pages).collect():
        more = "\n\nmore" if i % 2 else ""
        assert text == (f"Wrote {i}" if i >= 60 else f"Told {i}" if i % 10 // 5 else f"Head {i}\n\nSaid {i}{more}")


def test_an_article_keeps_what_all_pages_share(spark):
    """Headings and paragraphs that all articles of a host have stay; constant boxes and what lies outside go."""
    recipe = "<h2>Summary</h2><p>Text {i}</p><h2>Ingredients</h2><p>Salt</p><ul><li>Pepper</li></ul>"
    kinds = {
        "article": f"<div>Our kitchen</div><article>{recipe}<div>Join our list</div></article><p>All rights kept</p>",
        "plain": f"<div class=k>Our kitchen</div><div class=post>{recipe}<section><p>Join our list</p></section></div><div class=k>All rights kept</div>",
    }
    rows = [(100 * n + i, f"http://{kind}.org/{i}", html.replace("{i}", str(i))) for n, (kind, html) in enumerate(kinds.items()) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for i, _, text in wrappers.main_texts(pages).collect():
        assert text == f"Summary\n\nText {i % 100}\n\nIngredients\n\nSalt\n\nPepper"


def test_pages_table(spark):
    rows = [(i, f"http://host.org/{i}", site(i)) for i in range(9)]
    rows += [(20, "http://other.org/", site(20)), (21, None, None), (22, "nowhere", ""), (3, "http://host.org/3", site(3)), (23, "http://host.org/x", "<article>own</article>"), (None, "http://host.org/n", site(77))]
    pages = spark.createDataFrame([(*r, "h", "w") for r in rows], "page_id long, url string, html string, host string, wrapper string").repartition(3)
    got = [tuple(r) for r in wrappers.main_texts(pages).collect()]
    assert len(got) == len(rows)
    for i, url, text in got:
        if i is not None and i < 9:
            assert text == f"Story {i} about {i * 7}\n\nMore of story {i}"
        elif i is None:
            assert text.startswith("Story 77")
    by = {i: t for i, _, t in got}
    assert by[20] == "Welcome to our site\n\nStory 20 about 140\n\nMore of story 20\n\nThank you for reading"
    assert by[21] == by[22] == "" and by[23] == "own"
    assert wrappers.main_texts(pages.limit(0)).count() == 0


def rare(i, said):
    """A page whose layout only one other page of the host has."""
    return f"<body><div class=top>{said}</div><div class=post><p>Story {i}</p></div><div class='k{i // 2}'><div>Part {i}</div></div><div class=end>All rights kept</div></body>"


def test_all_pages_of_a_host_make_its_wrapper(spark):
    """Two of 40 pages do not have the greeting, so it is not template, whichever pages are looked at first."""
    rows = [(i, f"http://many.org/{i}", rare(i, "No greeting" if i in (7, 28) else "Welcome")) for i in range(40)]
    rows += [(100 + i, f"http://few.org/{i}", rare(i, "Welcome")) for i in range(12)]
    rows += [(None, "http://null.org/a", rare(0, "Hello")), *((i, f"http://null.org/{i}", rare(i, "Welcome")) for i in range(1, 6))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {(i, url): text for i, url, text in wrappers.main_texts(pages).collect()}
    for i, url, html in rows:
        story = f"Story {i or 0}\n\nPart {i or 0}" if i is None or i < 100 else f"Story {i - 100}\n\nPart {i - 100}"
        kept = "" if "few" in url else "No greeting\n\n" if i in (7, 28) else "Hello\n\n" if i is None else "Welcome\n\n"
        assert got[i, url] == kept + story


@pytest.mark.parametrize("block", [3, 1_000])
def test_wrapper_in_parts_is_the_wrapper_of_the_pages(spark, monkeypatch, block):
    """Sets of paths compared in blocks, pages matched one by one, against all pages of a host at once."""
    monkeypatch.setattr(wrappers, "WAYS_PER_BLOCK", block)
    rng = random.Random(5)
    hosts = {}
    for h in range(12):
        kinds = [[f"<div class=c{rng.randrange(4)}>{'<p>' if rng.random() < 0.4 else ''}{rng.choice(['Same', 'Fixed', '%d'])}</div>" for _ in range(rng.randrange(1, 5))] for _ in range(3)]
        hosts[f"h{h}.org"] = ["".join(part.replace("%d", str(rng.randrange(9))) for part in rng.choice(kinds)) + f"<div class=k{rng.randrange(6)}>{rng.choice(['tail', 'end'])}</div>" for _ in range(rng.randrange(3, 30))]
    rows = [(h, 1000 * n + i, html) for n, (h, pages) in enumerate(hosts.items()) for i, html in enumerate(pages)]
    got = dict(map(tuple, wrappers.host_wrappers(spark.createDataFrame(rows * 2, "host string, page_id long, html string").repartition(4)).collect()))
    for host, pages in hosts.items():
        want = wrappers.induced(pages)
        assert json.loads(got[host]) == want if want["template"] or want["content"] else host not in got
    assert len(got) > 4
