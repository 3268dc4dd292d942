"""Wrappers around whole articles, and dropped elements that do not end as they should."""

import pytest

from rainspark.llm import html_text

P = "The river rose after three days of rain and the town closed both bridges before noon"
Q = "Crews carried sand to the lower streets while the water stood in many kitchens of the town"


@pytest.mark.parametrize("before, after", [
    ("<body class='single comments-open has-sidebar'><article>", "</article></body>"),
    ("<div class='content-with-sidebar'><article>", "</article></div>"),
    ("<form id=aspnet><div class=content>", "</div></form>"),
    ("<form><main>", "</main></form>"),
    ("<div class=sidebar-wrap><article>", "</article></div>"),
])
def test_wrapped_articles_stay(before, after):
    assert html_text.main_text(f"{before}<p>{P}</p><p>{Q}</p>{after}", html_text.trained()) == f"{P}\n{Q}"


@pytest.mark.parametrize("between", [
    "<svg class=i />", "<video-player src=x></video-player>", "<button-group></button-group>", "<div><button>Go</div>", "<div><select><option>A</div>",
    "<div><object data=x></div>", "<svg><path d=1 /></svg>", "<video><p>No video here</p></video>", "<button>Go</button>",
])
def test_nothing_after_is_lost(between):
    assert html_text.main_text(f"<article><p>{P}</p>{between}<p>{Q}</p></article>", html_text.trained()) == f"{P}\n{Q}"


def test_math_stays_and_comments_go():
    page = f"<article><p>{P} <math><mi>x</mi></math></p></article><section id=comments><article class=comment><p>{Q}</p></article></section>"
    assert html_text.main_text(page, html_text.trained()) == f"{P} x"
