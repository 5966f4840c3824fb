import random
import time

import pytest

from quernstone.llm import markup


@pytest.mark.parametrize("text,kinds", [
    ("<p>Hi</p>", ["html"]), ("a<br>b", ["html"]), ("x &nbsp; y", ["html"]), ("&lt;p&gt;Hi&lt;/p&gt;", ["html"]), ("a <!-- c --> b", ["html"]), ('<a href="x">b</a>', ["html"]),
    ("# Head\ntext", ["markdown"]), ("Head\n====", ["markdown"]), ("some **bold** text", ["markdown"]), ("see [this](http://x.test/a_b)", ["markdown"]), ("`code`", ["markdown"]), ("```\nx = 1\n```", ["markdown"]), ("> quoted", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("an __old__ one", ["markdown"]),
    ("== Head ==", ["wiki"]), ("'''bold'''", ["wiki"]), ("a [[Page|link]]", ["wiki"]), ("{{Infobox|a=1}}", ["wiki"]),
    ("a [[b\n- c]] d", ["wiki"]), ("'''''a\n- b''''' c", ["wiki"]), ("[a\n- b](https://x.test)", ["markdown"]), ("`a\n- b`", ["markdown"]), ("- **24/7 * 365**", ["markdown"]), ("\\textbf{x}", ["latex"]), ("$x_{5} \\leq y^{2}$", ["latex"]), ("\\begin{equation}\nn\n\\end{equation}", ["latex"]), ("as shown~\\cite{a3}", ["latex"]), ("$O(n \\log n)$", ["latex"]),
    ("<p>a</p> and \\emph{b} and **c** and [[d]]", ["html", "latex", "markdown", "wiki"]),
] + [(t, []) for t in (
    "", "- a dash\n- another", "• dot", "<jobs@talent.invalid>", "R&D: 3 < n < 9", "<3 you", "C#, C++ & F#", "KPI #1: uptime > 99.5%", "- #712 Name", "Budget: $80k-$95k *", "C:\\temp\\New", "F(x) = x^2 - 135", "5'11\" / 180 cm ~", "12/3 * 4", "3 * 4 = 6 + 6",
    "Config_v2_final.yaml", "A -> B -> C", "[m/w/d]", "snake_case_name and __init__.py", "AT&T; and a < b > c", "List<String> x", "10 > 9", "a == b", "don't ''",
)])
def test_kinds(text, kinds):
    assert markup.kinds_of(text) == kinds


@pytest.mark.parametrize("text,clean", [
    ("<h2>Head</h2><ul><li>a</li><li>b &amp; c</li></ul>", "## Head\n\n- a\n- b & c"), ("&lt;p&gt;x&lt;/p&gt;", "x"), ("<style>.x{}</style>Text", "Text"), ("<pre>a\n  b</pre>", "```\na\n  b\n```"), ("<p>a</p><ol><li>b<li>c<ul><li>d</ul><li>e</ol>f", "a\n\n1. b\n2. c\n- d\n3. e\n\nf"),
    ("## Head ##\n\n* **a** b\n+ c", "## Head\n\n- a b\n- c"), ("Head\n----\nx", "## Head\n\nx"), ("a [b](c) ![d](e.png)", "a b d"), ("```\nx = '*a*'\n```", "```\nx = '*a*'\n```"), ("use `a_b` now", "use a_b now"), ("| a | b |\n|---|---|\n| 1 | 2 |", "a\tb\n\n1\t2"),
    ("== Head ==\n* \'\'\'a\'\'\' [[b|c]] [[d]] [[Category:x]]", "## Head\n\n- a c d"), ("{{Infobox|a=1}}\ntext", "text"), ("== H ==\n#a\n#b\n\n[[c]]", "## H\n\n1. a\n2. b\n\nc"),
    ("\\section{Head} x \\textbf{b}~\\cite{q} $a_{1}^{2}$", "# Head\n\n x b $a_{1}^{2}$"), ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "- a\n- b"), ("\\begin{equation}\nn = \\frac{1}{k}\n\\end{equation}", "\\begin{equation}\nn = \\frac{1}{k}\n\\end{equation}"),
    ("\\begin{enumerate}\\item a $x_1$\\begin{verbatim}\\textbf{y}\\end{verbatim}\\item b\\end{enumerate}", "1. a $x_1$\n```\n\\textbf{y}\n```\n\n2. b"), ("a **b _c __d *e* d__ c_ b** ***f***", "a b c d e d c b f"), ("<pre>**a** \\emph{b}</pre> **c** \\emph{d}", "```\n**a** \\emph{b}\n```\n\n c d"),
    ("R&D: 3 < n < 9 *", "R&D: 3 < n < 9 *"), ("**a** \x005\x00 \x01", "a 5"), ("a [[b\n- c]] d", "a b\n- c d"),
])
def test_clean_text(text, clean):
    assert markup.render(text, markup.kinds_of(text))[0] == clean


@pytest.mark.parametrize("n", [18, 1000, 1001, 30_000])
def test_every_latex_command_is_unwrapped(n):
    text = "\\section{A} " + "\\emph{x \\textbf[o]{y}} {z} " * n + "\\a{" * n
    assert markup.render(text, markup.kinds_of(text))[0] == "# A\n\n " + ("x y {z} " * n).strip()


@pytest.mark.parametrize("text,clean", [("\\textbf\\emph{{x}} y", "x y"), ("\\a{b \\c[d}]{e} f", "b e f"), ("\\a[\\b{c}]{d}", "d"), ("} \\a{{b} c", "} {b} c"), ("\\a{\\}b{c}", "c")])
def test_latex_commands_put_together(text, clean):
    assert markup.render(text, ["latex"])[0] == clean


FOOTER = "<div><p>All rights reserved by the host</p></div>"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "id string, host string, description string, text string, markup string")
    return {(r.id, r.host): r for r in markup.clean(df, "id", "description", "host").collect()}


def test_a_hosts_template_goes_but_not_reposts_or_other_hosts(spark):
    pages = [(f"p{i}", "h", f"<p>page {i}</p>{FOOTER}") for i in range(8)]
    reposts = [(f"r{i}", "g", "<p>the same</p>") for i in range(9)]
    other = [("o", "k", f"<p>only</p>{FOOTER}"), ("n", None, None), ("m", None, "plain * text"), ("e", "h", "")]
    got = run(spark, pages + pages[:2] + reposts + other)
    assert len(got) == 8 + 9 + 4
    assert {(r.clean_text, r.removed) for (i, h), r in got.items() if h == "h" and i != "e"} == {(f"page {i}", 1) for i in range(8)}
    assert {(r.clean_text, r.removed) for (i, h), r in got.items() if h == "g"} == {("the same", 0)}
    assert got["o", "k"].clean_text == "only\n\nAll rights reserved by the host"
    assert (got["m", ""].clean_text, got["m", ""].markup, got["n", ""].clean_text, got["e", "h"].clean_text) == ("plain * text", [], "", "")


def test_templates_beyond_the_broadcast_bound(spark, monkeypatch):
    pages = [(f"p{i}", "h", f"<p>page {i}</p>{FOOTER}") for i in range(8)] + [("o", "k", f"<p>only</p>{FOOTER}"), ("n", None, None)]
    known = {k: (r.clean_text, r.removed) for k, r in run(spark, pages).items()}
    monkeypatch.setattr(markup, "BROADCAST_TEMPLATES", 0)
    assert {k: (r.clean_text, r.removed) for k, r in run(spark, pages).items()} == known


@pytest.mark.parametrize("seed", range(3))
def test_planted_markup_comes_out(seed):
    """Known structure written in each kind of markup is read back whole."""
    r = random.Random(seed)
    words = lambda: " ".join(r.choice(["red", "blue", "A&B", "x2", "snake_case", "3 < 5"]) for _ in range(6))
    for _ in range(200):
        head, text, items, code = words(), words(), [words() for _ in range(3)], "if a < b:\n    run(*c, **d)"
        escaped = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
        pages = {
            "html": f"<h2>{escaped(head)}</h2><p>{escaped(text)} <b>x</b></p><ul>{''.join(f'<li>{escaped(i)}</li>' for i in items)}</ul><pre>{escaped(code)}</pre>",
            "markdown": f"## {head}\n\n{text} **x**\n\n" + "".join(f"* {i}\n" for i in items) + f"\n```\n{code}\n```",
            "wiki": f"== {head} ==\n\n{text} '''x'''\n\n" + "".join(f"* {i}\n" for i in items),
            "latex": f"\\subsection{{{head}}}\n\n{text} \\textbf{{x}}\n\n\\begin{{itemize}}\n" + "".join(f"\\item {i}\n" for i in items) + f"\\end{{itemize}}\n\n\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}",
        }
        for kind, page in pages.items():
            got = markup.render(page, markup.kinds_of(page))[0]
            assert markup.kinds_of(page) == [kind] and f"## {head}" in got and f"{text} x" in got and all(f"- {i}" in got for i in items), (page, got)
            assert kind == "wiki" or f"```\n{code}\n```" in got


@pytest.mark.parametrize("depth", [250, 5000])
def test_deep_elements(depth):
    text = "<div>" * depth + "<script>x<1</script><p>a</p><ul><li>b</li></ul>" + "<b>" * depth + "c"
    assert markup.render(text, ["html"])[0] == "a\n\n- b\n\nc"
    assert len(markup.hashed(markup.tree(text, ["html"]))) >= 2 * depth


def test_nothing(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("text", ["<" * 50_000, "*" * 50_000, "[" * 20_000, "{{" * 10_000, "$" * 20_000, "<b>" * 3000, "'" * 50_000, "\\a{" * 500, "_" * 50_000, "a_b " * 10_000, "`" * 20_001, "|" * 20_000, "<!--" * 20_000, "\\begin{a}" * 20_000, "\\(" * 20_000, "**a _b " * 10_000, "{|\n" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "\\cite[" * 10_000])
def test_hostile_texts_end(text):
    began = time.process_time()
    markup.render(text, markup.kinds_of(text))
    markup.render(text, ["html", "latex", "markdown", "wiki"])
    assert time.process_time() - began < 8
