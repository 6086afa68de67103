import pytest

from affinity.llm.markup import clean_text, scan


@pytest.mark.parametrize(
    "text, clean, kinds",
    [
        ("# Head\ntext", "# Head\ntext", ["markdown"]),
        ("Head\n====\ntext", "# Head\ntext", ["markdown"]),
        ("a **b** _c_ ~~d~~ __e__ *f*", "a b c d e f", ["markdown"]),
        ("see [x](y.md) and ![i](p.png) and [t][r]\n\n[r]: u/v.md", "see x and i and t", ["markdown"]),
        ("- [ ] do\n- [x] done", "- do\n- done", ["markdown"]),
        ("| a | b |\n|---|:--:|\n| 1 | 2 |", "a | b\n1 | 2", ["markdown"]),
        ("a `<b>x</b> [[y]] $z_1$` c", "a `<b>x</b> [[y]] $z_1$` c", ["markdown"]),
        ("~~~\n\\section{x} {{t}}\n~~~", "```\n\\section{x} {{t}}\n```", ["markdown"]),
        ("[[A]] and [[B|c]] ![[D#e]] [[Category:F]]", "A and c D", ["wiki"]),
        ("'''b''' ''i'' '''''x'''''", "b i x", ["wiki"]),
        ("== Head ==\n* item", "# Head\n* item", ["wiki"]),
        ("{{a\n| b = {{c}}\n}} d", "d", ["wiki"]),
        ('{| class="x"\n|-\n| a || 1\n|}', "a | 1", ["wiki"]),
        ("<p class='x'>a &amp; b<br/>c</p>", "a & b\nc", ["html"]),
        ("<!-- a > b -->c <script>1 < 2;</script>d", "c d", ["html"]),
        ("x&nbsp;y &#8211; &amp;lt;z&amp;gt;", "x y – <z>", ["html"]),
        ("<UL>\n<LI>a\n<LI>b\n</UL>", "- a\n\n- b", ["html"]),
        ("text</span> on", "text on", ["html"]),
        ("\\section{Head}\n\\emph{a} \\textbf{b \\textit{c}}\\label{x}", "# Head\na b c", ["latex"]),
        ("a $x_1$ b \\(y\\) \\[ z^2 \\]", "a $x_1$ b $y$ $$z^2$$", ["latex"]),
        ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "- a\n- b", ["latex"]),
        ("\\begin{verbatim}\nx = 1\n\\end{verbatim}", "```\nx = 1\n```", ["latex"]),
    ],
)
def test_families_and_clean_text(text, clean, kinds):
    found, families = scan(text)
    assert families == kinds
    assert [x.strip() for x in found.split("\n") if x.strip()] == [x.strip() for x in clean.split("\n") if x.strip()]


@pytest.mark.parametrize(
    "text",
    [
        "It cost $26 and later $49 per piece.", "Only if 8 < 19 and 33 > 25 holds.", "I <3 Zu, x = 3, y <= 5.", "R&D said",
        "Size 7 * 4 * 3 cm.", "The field kona_nolefa_vime stays.", "About 3 m^2, see a_8 and {b}.", "Saved to C:\\mifa\\dero on",
        "Filed as #lani and #wa/lo.", "See footnote [34] of X.", "a -> b, then c | d.", "bay #15.", "- a\n- b\n1. c", "it's 'fine' and ''", "a & b; c",
        "> quoted", "----", "x == y", "``", "$", "**", "a * b * c", "__init__x", "2 ** 3",
    ],
)
def test_what_is_no_markup(text):
    assert scan(text) == (text, [])


def test_title_is_not_part_of_the_first_line():
    assert scan("Name # Head\ntext", "Name") == ("Name # Head\ntext", ["markdown"])
    assert scan("Name # Head\ntext")[1] == []


def test_odd_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", "b", "x"), (3, "**a**", None, "x"), (3, "**a**", None, "x"), (None, "<b>x</b>", "c", "y"), (4, "\ue000**a** " * 20_000, None, "")]
    df = spark.createDataFrame(rows, "note_id bigint, text string, title string, kinds string")
    got = clean_text(df, "note_id", "text", "title").distinct().collect()
    found = {r.id: (r.text, r.kinds) for r in got}
    assert len(got) == 5
    assert found[1] == (None, []) and found[2] == ("", []) and found[3] == ("a", ["markdown"]) and found[None] == ("x", ["html"])
    assert found[4][1] == ["markdown"] and "*" not in found[4][0] and found[4][0].count("\ue000") == 20_000
    assert clean_text(df.limit(0), "note_id", "text").collect() == []


def test_nesting_has_no_limit():
    for depth in (1, 12, 5000):
        assert scan("a " + r"\textbf{" * depth + "x" + "}" * depth + " b") == ("a x b", ["latex"])
        assert scan("a " + "{{t|" * depth + "x" + "}}" * depth + "b") == ("a b", ["wiki"])
    assert scan("&" + "amp;" * 9 + "lt; 3")[0] == "< 3"
    assert scan(r"\emph{a {b} c} and \label{x \ref{y}}z \footnote{n}")[0] == r"\emph{a {b} c} and z  (n)"
    assert scan("a }} b {{ c")[1] == [] and scan("{{a}} }} {{b")[0] == "}} {{b"
