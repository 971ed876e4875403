"""Pages of many shapes: wrappers with odd names, several articles, menus that nothing marks, comments; the threshold decides."""

import pytest

pytest.importorskip("public_tokenizers")

from undertow.llm import html_text  # noqa: E402
from undertow.llm.html_text import Ratios, main_text  # noqa: E402


def words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


A, B, C = words("a", 90), words("b", 70), words("c", 40)
MENU = "<div><a href=1>Home</a> <a href=2>News</a> <a href=3>More</a></div>"

CASES = {
    "wrapper by what it has": (f'<body><div class="content has-sidebar"><h1>T</h1><p>{A}<p>{B}</div><div class="sidebar">{C}</div></body>', ["T", A, B]),
    "wrapper by its look": (f'<body><div id="page" class="layout sidebar-left"><h1>T</h1><p>{A}</p><p>{B}</p><div class="sidebar"><p>{C}</p></div></div></body>', None),
    "notes and related work": (f'<article><h1>T</h1><p>{A}</p><div class="form-note">{C}</div><section class="related-work"><h2>R</h2><p>{B}</p></section></article>', ["T", A, C, "R", B]),
    "several articles": (f"<body>{MENU}<div><article><p>{A}</p></article><article><p>{B}</p></article></div><footer>f</footer></body>", [A, B]),
    "no article": (f"<body>{MENU}<div><h2>H</h2><p>{A}</p><p>{B}</p></div><div class=footer>imprint</div></body>", ["H", A, B]),
    "menu between parts": (f"<body><div><p>{A}</p><p>{A}</p></div><div><ul><li><a href=1>x</a></li><li><a href=2>y</a></li><li><a href=3>z</a></li><li><a>u</a></li><li><a>v</a></li><li><a>w</a></li><li><a>s</a></li></ul></div><div><p>{B}</p><p>{B}</p></div></body>", [A, A, B, B]),
    "more comments than text": (f'<body><article><p>{A}</p></article><section class="comments"><h1>Comments</h1>' + f"<p>{B}</p>" * 9 + "</section></body>", [A]),
    "marked paragraph": (f'<article><p>{A}</p><p class="ad">{C}</p><p class="lead">{B}</p></article>', [A, B]),
    "lone advert, short text": (f'<body><div class="ad">{C}</div><article><h1>Few</h1><p>words</p></article></body>', ["Few", "words"]),
    "all marked": (f'<body class="x"><div class="widget"><p>{A}</p></div></body>', [A]),
    "roles, forms, scripts": (f'<body><div role=navigation>{C}</div><main><p>{A}<script>var x="<p>no";</script><form>{C}</form><p>{B}</main><div role="contentinfo">z</div></body>', [A, B]),
    "references and white space": (f"<article><p>x &amp; y&nbsp;&lt;z\n\t  {A}<br>next</article>", [f"x & y <z {A}", "next"]),
    "a list of links in the text": (f"<article><p>{A}</p><p>{B}</p><ul><li><a>{C}</a> said so</li><li>{C}</li></ul></article>", [A, B, f"{C} said so", C]),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    if want is None:
        want = ["T", A, B]
    assert main_text(page).split("\n") == want


def test_the_threshold_and_the_smoothing_decide():
    page = f"<body><div><p>one <i>two</i> <b>three</b> <u>four</u></p><p>short <i>x</i> <b>y</b></p></div><div><p>{A}</p><p>{B}</p></div></body>"
    few = "one two three four\nshort x y"
    assert main_text(page, Ratios(share_of_deviation=1.0)) == f"{A}\n{B}"
    assert main_text(page, Ratios(share_of_deviation=0.0)) == f"{few}\n{A}\n{B}"
    assert main_text(page, Ratios(sigma=30.0)) == f"{few}\n{A}\n{B}"


def test_rows(spark):
    long = "<p>" + "word " * 200_000
    rows = [(1, "u", CASES["no article"][0], "t", 5), (1, "u", CASES["no article"][0], "t", 5), (None, None, None, None, None), (2, "v", "", "x", 1), (3, "w", long, "", 0), (4, "z", "<div><nav>only</nav>", "", 0)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(d).collect()))
    full = "\n".join(CASES["no article"][1])
    assert got == sorted([("1", full, len(full)), ("1", full, len(full)), ("None", "", 0), ("2", "", 0), ("3", long[3:].strip(), len(long) - 4), ("4", "", 0)])
    assert html_text.extract(d.filter("false")).count() == 0
