"""What belongs to an article and what does not, with and without a mark, against a plain surge and dive."""

import random

import pytest

from quillspark.llm import html_extract

LONG = "word " * 59 + "word"
SMALL = "Small words"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>News</p><p>By A</p><p>2 min</p><p>{LONG}</p></article>", ["News", "By A", "2 min", LONG]),
        (f"<article>{''.join(f'<p>{k}</p>' for k in range(6))}<p>{LONG}</p><p>{SMALL}</p></article>", [*"012345", LONG, SMALL]),
        (f"<div><p>Lead one.</p><p>a b</p><p>c d</p><p>{LONG}</p></div>", ["Lead one.", "a b", "c d", LONG]),
        (f"<div><p>{LONG}</p><p><a href=x>Full report</a></p></div>", [LONG, "Full report"]),
        (f"<div><p>{LONG}</p>{'<p><a href=x>L</a></p>' * 4}<p>Closing remark.</p></div>", [LONG, *"LLLL", "Closing remark."]),
        (f'<article><p class="ad-hoc">Adhoc</p><div class="sidebar-note">Note</div><p>{LONG}</p><object>Obj</object><map>Map</map></article>', ["Adhoc", "Note", LONG, "ObjMap"]),
        (f'<article><div class="ad-slot">x</div><p>{LONG}</p><div class="sidebar">y</div><aside>z</aside></article>', [LONG]),
        (f"<article><p>{LONG}</p></article><p>Between {LONG}</p><article><p>{LONG} 2</p></article>", [LONG, f"{LONG} 2"]),
        (f"<article><p>{LONG}</p></article><article><p>Card</p></article>", [LONG]),
        (f"<body><p><a>Home</a></p><p>{LONG}</p><p><a>Next</a></p></body>", [LONG]),
        (f"<body><ul><li><a>n</a></ul><div><ul><li><a>crumb</a></ul><h1>T</h1><p>x</p><p>{LONG}</p></div><div class='sidebar-left'>S {LONG}</div></body>", ["T", "x", LONG]),
        ("<article><p>Tiny</p></article>", ["Tiny"]),
        ("<body><p></p></body>", []),
    ],
)
def test_cases(page, want):
    assert html_extract.main_text(page) == "\n\n".join(want)


def plain_regions(weights):
    """Lines from a window of SURGE characters to the next one of none, region by region."""
    n = len(weights)
    window = [sum(weights[i : i + html_extract.WINDOW]) for i in range(n)]
    need = min(html_extract.SURGE, max(window, default=0) / 8)
    out, i = [], 0
    while i < n:
        if weights[i] and window[i] >= need:
            end = next((k for k in range(i, n) if not window[k]), n)
            held = [k for k in range(i, end) if weights[k]]
            out.append((i, held[-1]))
            i = end
        else:
            i += 1
    heavy = max((sum(weights[a : b + 1]) for a, b in out), default=0)
    return [(a, b) for a, b in out if sum(weights[a : b + 1]) >= html_extract.SHARE * heavy]


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    """Pages with and without a mark: what is in the article comes out whole and nothing else does."""
    r = random.Random(seed)
    sentence = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(n))
    body = [sentence(r.choice([1, 3, 8, 40, 90])) for _ in range(r.randint(1, 12))]
    body[r.randrange(len(body))] = sentence(120)
    tag = r.choice(["article", "main", "div"])
    inside = "".join(f"<p>{t}</p>" + ("<script>x()</script>" if r.random() < 0.2 else "") + ('<div class="ad">buy</div>' if r.random() < 0.2 else "") for t in body)
    page = f"<html><head><title>t</title></head><body><nav><ul>{'<li><a href=/>menu</a></li>' * 5}</ul></nav><{tag}>{inside}</{tag}><div id=comments><p>{sentence(30)}</p></div><footer><p>{sentence(20)}</p></footer></body></html>"
    assert html_extract.main_text(page) == "\n\n".join(body)
    weights = [r.choice([0, 0, 5, 40, 200]) for _ in range(r.randint(0, 60))]
    assert html_extract.regions(weights) == plain_regions(weights)
