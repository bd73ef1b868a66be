"""WARC archives and HTML extraction."""

import gzip
import hashlib

import pytest

from tests.llm.conftest import bag


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "same payload é " * 20 + "</p>"
    rows = [(5, "http://a/", big), (2, "http://b/", big), (9, None, big), (1, "u", "<p>short</p>"), (3, "u", "<p>short</p>"), (None, "n", big), (4, "x", None), (6, "x", ""), (7, "l", "y" * 300_000), (7, "l", "y" * 300_000), (8, "r", "\r\n\r\n" * 60)]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, _id int, _html string").repartition(3)


def test_archives(pages):
    from lodecast.llm.files import opened
    from lodecast.llm.warc import normalise_archives, read_archives, write_archives

    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    least = {}
    for i, p in rows:
        least[p] = min([v for v in (least.get(p), i) if v is not None], default=None)
    expected = []
    for i, p in rows:
        again = len(p) >= 100 and least[p] != i
        expected.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", least[p] if again else None))
    sources = write_archives(pages)
    places = [r["place"] for r in sources.collect()]
    whole = b""
    for place in places:
        with opened(place) as file:
            whole += gzip.decompress(file.read())
    archives = normalise_archives(sources)
    found = read_archives(archives)
    assert bag(found.drop("url", "payload").collect()) == bag(expected)
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in found.where("record_type = 'response'").collect())
    members = b""
    for r in sorted(archives.collect()):
        with opened(r["place"]) as file:
            members += gzip.decompress(file.read())
    assert len(members) == len(whole) and sorted(members.split(b"WARC/1.1")) == sorted(whole.split(b"WARC/1.1"))
    assert bag(read_archives(normalise_archives(sources, remove_sources=True)).drop("url", "payload").collect()) == bag(expected)
    # A task that runs again after its source is gone finds its work done.
    assert bag(read_archives(normalise_archives(sources, remove_sources=True)).drop("url", "payload").collect()) == bag(expected)
    assert read_archives(normalise_archives(write_archives(pages.limit(0)))).collect() == []


def test_stream_parts():
    from lodecast.llm.warc import headers, inflated, record, records

    parts = [record(i, "u", "response", "d", i, b"\r\n" * (i // 2) + b"x" * (i % 2), None) for i in range(50)]
    data = gzip.compress(b"".join(parts[:30])) + gzip.compress(b"".join(parts[30:]))
    for size in (1, 7, 1000, 1 << 20):
        chunks = (data[k : k + size] for k in range(0, len(data), size))
        assert list(records(inflated(chunks))) == parts
    assert headers(parts[3])["x-page-id"] == "3"
    with pytest.raises(ValueError):
        list(records(iter([parts[3][:-10]])))


PROSE = "This is the first of the paragraphs that we have in the page, and it is long enough to be seen as a good block by the rules, as it has many of the words that are in the list and it goes on for a while."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just a line", ""),
        ("<article><p>One.<p>Two &amp; three&#33;<br>four</article>", "One.\nTwo & three! four"),
        (f"<nav><a href=x>Home</a></nav><div class='post-body'><h2>Head</h2><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><footer>{PROSE}</footer>", f"Head\n{PROSE}\nShort.\n{PROSE}"),
        (f"<div><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><div id=comments><p>{PROSE}</p></div><div><a href=1>More links that are</a> <a href=2>here</a></div>", f"{PROSE}\nShort.\n{PROSE}"),
        (f"<article><p>{PROSE}</p><div class='ad'><p>Buy</p></div><script>if (a < b) '</p>'</script><!-- <p>no --><form><p>{PROSE}</p></form></article>", PROSE),
        (f"<body class='with-sidebar'><header><h1>Site</h1></header><aside>{PROSE}</aside><main><p>{PROSE}</p></main>", PROSE),
        ("<article><p a='>'>x > y < z</p><p>t \n u</p></article>", "x > y < z\nt u"),
        (f"<article><p>{PROSE}</p><section class='comments'><article><p>{PROSE} no</p></article></section></article>", PROSE),
    ],
)
def test_blocks(page, text):
    from lodecast.llm.html_blocks import main_text

    assert main_text(page) == text


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-sidebar", "hidden-nav", "page-search-enabled", "sidebar-left", "layout-sidebar"])
def test_a_part_of_a_layout_name_loses_no_text(name):
    from lodecast.llm.html_blocks import main_text

    for inner in (f"<p>{PROSE}</p><p>{PROSE}</p>", f"<article><p>{PROSE}</p></article>", f"<main><p>{PROSE}</p></main>"):
        text = "\n".join([PROSE] * inner.count(PROSE))
        assert main_text(f"<div class='{name}'>{inner}</div>") == text
        assert main_text(f"<div id='{name}'>{inner}</div><div class=footer><p>{PROSE} foot</p></div>") == text


def test_outside_names():
    from lodecast.llm.html_blocks import main_text

    main = f"<p>{PROSE}</p><p>{PROSE}</p>"
    for name in ("sidebar", "sidebar-widget", "comment_list", "site-footer", "main nav", "post-comments"):
        assert main_text(f"<div>{main}</div><div class='{name}'><p>{PROSE} no</p></div>") == f"{PROSE}\n{PROSE}"
    # A main part ends a name around it; an article there gives way to as much text elsewhere.
    assert main_text(f"<div class='overlay'><main>{main}</main></div>") == f"{PROSE}\n{PROSE}"
    assert main_text(f"<div class='related'><article><p>{PROSE} no</p></article></div><article>{main}</article>") == f"{PROSE}\n{PROSE}"
    assert main_text(f"<aside><main>{main}</main></aside>") == ""


def test_extract(spark, pages):
    from lodecast.llm.html_blocks import extract_text, main_text

    found = extract_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    texts = [(r["page_id"], r["url"], main_text(r["html"] or "")) for r in pages.collect()]
    assert bag(found.collect()) == bag((*t, len(t[2])) for t in texts)
    assert extract_text(pages.limit(0)).collect() == []


def test_ambiguous_blocks_take_the_nearest_label():
    from lodecast.llm.html_blocks import Block, classify

    def made(*kinds):
        texts = {"g": PROSE, "s": "Short.", "b": "zxq " * 60, "h": "Head"}
        return [Block(texts[k], 1.0 if k == "b" else 0.0, False, False, k == "h") for k in kinds]

    for kinds, labels in (("gsg", "ggg"), ("gssb", "ggbb"), ("bsb", "bbb"), ("bhg", "bgg"), ("sg", "bg")):
        blocks = made(*kinds)
        classify(blocks)
        assert "".join(b.label[0] for b in blocks) == labels


class Plain:
    """The rules once more, on well-formed pages: a parser of the standard library, and neighbours looked for one by one."""

    BLOCKS = {"p", "div", "li", "ul", "nav", "article", "h1", "footer", "body", "html", "head"}
    NOT_MAIN = {"nav", "footer", "head"}

    def __init__(self, page):
        from html.parser import HTMLParser

        out, stack, text = [], [], []

        def flush():
            words = " ".join("".join(t for t, _ in text).split())
            if words:
                seen = sum(len(t.replace(" ", "")) for t, _ in text)
                linked = sum(len(t.replace(" ", "")) for t, a in text if a) / seen
                out.append([words, linked, "article" in stack, any(s in self.NOT_MAIN or s == "ad" for s in stack), "h1" in stack])
            text.clear()

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag in Plain.BLOCKS:
                    flush()
                    if "p" in stack and tag != "li":
                        while stack.pop() != "p":
                            pass
                if tag not in ("br", "meta", "b"):
                    stack.append("ad" if ("class", "ad") in attrs else tag)
                elif tag == "br":
                    text.append((" ", False))

            def handle_endtag(self, tag):
                if tag in Plain.BLOCKS:
                    flush()
                names = [("div" if s == "ad" else s) for s in stack]
                if tag in names:
                    del stack[len(names) - 1 - names[::-1].index(tag) :]

            def handle_data(self, data):
                if not {"script", "style", "title"} & set(stack):
                    text.append((data, "a" in stack))

        reader = Reader()
        reader.feed(page)
        reader.close()
        flush()
        self.blocks = out

    def text(self):
        import re

        from lodecast.llm.html_blocks import STOP_WORDS

        blocks = self.blocks
        words = [re.findall(r"[^\W\d_]+", b[0].lower()) for b in blocks]
        stops = [sum(w in STOP_WORDS for w in ws) / max(len(ws), 1) for ws in words]
        inner = [k for k, b in enumerate(blocks) if not b[3]]
        every = [w for k in inner for w in words[k]]
        if every and sum(w in STOP_WORDS for w in every) / len(every) < 0.04:
            stops = [0.22] * len(blocks)
        score = []
        for (t, linked, main, outside, _), s in zip(blocks, stops, strict=True):
            size = "long" if len(t) >= 200 else "middle" if len(t) >= 70 else "short"
            if linked > 0.4:
                own = {"long": -3}.get(size, -2)
            elif size == "short":
                own = -1 if linked else 0
            elif s >= 0.22:
                own = {"long": 3, "middle": 2}[size]
            else:
                own = int(s >= 0.12 or size == "long")
            score.append(own + 2 * main - 6 * outside)
        enough = min(3, max([1, *score]))
        first = ["g" if s >= enough else "b" if s <= -1 else "" for s in score]

        def look(k, step):
            """Label and distance of the nearest decided neighbour to one side."""
            own, j, n = blocks[k], k + step, 1
            while 0 <= j < len(blocks):
                inside = blocks[j][2] and not blocks[j][3]
                if own[2] and not blocks[j][2] and not blocks[j][3]:
                    return "", n
                if blocks[j][3]:
                    if not own[2]:
                        return "b", n + 2
                elif inside != own[2]:
                    return ("" if own[2] else "b"), n + 1
                elif first[j]:
                    return first[j], n
                j, n = j + step, n + 1
            return ("" if own[2] else "b"), n

        out = []
        for k, b in enumerate(blocks):
            label = first[k]
            if not label:
                (left, a), (right, c) = look(k, -1), look(k, 1)
                if not left or not right:
                    label = left or right or ("g" if score[k] > 0 else "b")
                elif left == right:
                    label = left
                elif score[k] > 0 or b[4] and right == "g":
                    label = "g"
                elif a != c:
                    label = left if a < c else right
                else:
                    label = "g" if stops[k] >= 0.22 and not b[1] else "b"
            if label == "g":
                out.append(b[0])
        return "\n".join(out)


def sample_pages():
    import duckdb

    return [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]


def without_article(page):
    return page.replace("<article>", "<div>").replace("</article>", "</div>")


def test_rules_against_a_second_version():
    from lodecast.llm.html_blocks import main_text

    for page in sample_pages():
        for own in (page, without_article(page), without_article(page).replace(' class="ad"', ""), without_article(page).replace("nav>", "div>").replace("footer>", "div>")):
            assert main_text(own) == Plain(own).text()


def test_rules_find_the_text_without_the_article_tag():
    from collections import Counter

    from lodecast.llm.html_blocks import blocks_of, main_text

    right = true = got = 0
    for page in sample_pages():
        whole = Counter(b.text for b in blocks_of(page) if b.main and not b.outside)
        found = Counter(t for t in main_text(without_article(page)).split("\n") if t)
        right, true, got = right + sum((whole & found).values()), true + sum(whole.values()), got + sum(found.values())
    assert right / true >= 0.95 and right / got >= 0.95


@pytest.mark.parametrize("part", ["<a ", "<ul>", "<section>x", "<p>", "<div class=ad>", "<b>", "<a b='", "</p>", "<script>", "<li>x", "<h1>x", "<!--", "&amp;"])
def test_broken_pages_take_linear_time(part):
    import time

    from lodecast.llm.html_blocks import main_text

    def seconds(n):
        start = time.perf_counter()
        main_text(part * n)
        return time.perf_counter() - start

    assert seconds(60_000) < 20 * seconds(6_000) + 0.5


_LINE = "<p>The cat sat down by the old door at noon.</p>"
_SAID = "The cat sat down by the old door at noon."
_NAV = "<nav><a href=1>Home</a> <a href=2>News</a></nav>"
_FOOT = "<footer>All rights are with us and the authors of the page</footer>"


@pytest.mark.parametrize("around", [("", ""), (_NAV, _FOOT), ("<div class=menu><a href=1>Home</a></div>", "<div><a href=1>More of it</a></div>")])
@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<div><h1>A title of it</h1>{_LINE * 8}</div>", "\n".join(["A title of it", *[_SAID] * 8])),
        (_LINE, _SAID),
        ("<div>— Who is it?</div><div>— It is me.</div><div>— Come in, then.</div>", "— Who is it?\n— It is me.\n— Come in, then."),
        ("<p>Over the hill<br>and far away</p><p>the old man sang</p>", "Over the hill and far away\nthe old man sang"),
        (f"{_LINE}<aside>An advert of the day</aside>{_LINE}", f"{_SAID}\n{_SAID}"),
        ("<p>Zxq wv mnop</p>", "Zxq wv mnop"),
    ],
)
def test_pages_of_short_blocks_keep_their_text(around, body, text):
    from lodecast.llm.html_blocks import main_text

    assert main_text(f"<html><body>{around[0]}{body}{around[1]}</body></html>") == text


def test_pages_of_links_alone_have_no_text():
    from lodecast.llm.html_blocks import main_text

    assert main_text(f"<body>{_NAV}<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>{_FOOT}</body>") == ""
