"""Pages without an article, class names that only look like adverts, and what the tree splits on."""

import pytest

from rainspark.llm import html_text

LONG = "The river rose after three days of rain and the town closed both bridges before noon while crews carried sand to the streets below it"
MIDDLE = "Both bridges were closed before noon and the school was opened for the night"
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News and reports</a></li><li><a href=/c>Contact</a></li></ul>"


def text_of(page):
    return html_text.main_text(page, html_text.trained())


def test_the_table_is_labelled_and_its_tree_asks_density_and_neighbours():
    asked = {html_text.FEATURES[int(n)] for n in html_text.trained().nodes[:, 0] if n >= 0}
    assert len(html_text.PAGES) >= 40
    assert {"words", "link_density", "place"} <= asked and asked & {"words_before", "words_after", "link_density_before", "link_density_after"}


@pytest.mark.parametrize("paragraphs", [[MIDDLE] * 4, [LONG] * 3, [MIDDLE, LONG, MIDDLE], [" ".join(MIDDLE.split()[:n]) for n in (8, 12, 9)]])
@pytest.mark.parametrize("around", ["{}", MENU + "{}", "{}<div><a href=/x>Privacy</a></div><div>All rights reserved</div>", "<nav>" + MENU + "</nav><div>{}</div><footer>Paper</footer>"])
def test_pages_without_an_article(paragraphs, around):
    assert text_of(around.format("".join(f"<p>{p}</p>" for p in paragraphs))) == "\n".join(paragraphs)


def test_headings_of_plain_pages_stay():
    assert text_of(f"{MENU}<h2>Flood in town</h2><p>{LONG}</p><h3>The night</h3><p>{LONG}</p><p>{MENU}") == f"Flood in town\n{LONG}\nThe night\n{LONG}"


@pytest.mark.parametrize("name", ["ad-free", "form-of-address", "social-history", "footer-notes-on-law", "article-header", "entry-header", "no-ads"])
def test_names_that_only_hold_a_name_of_something_apart(name):
    assert text_of(f"<article><p>{LONG}</p><p class='{name}'>{MIDDLE}</p></article>") == f"{LONG}\n{MIDDLE}"


@pytest.mark.parametrize("name", ["ad", "top-menu", "cookie_banner", "comment-list", "sidebar-left", "ad-slot-2", "site-footer", "related-posts", "AD", "x advert"])
def test_names_of_something_apart(name):
    assert text_of(f"<article><p>{LONG}</p><div class='{name}'><p>{MIDDLE}</p></div></article>") == LONG


def test_links_of_an_article_stay_and_lists_of_links_elsewhere_go():
    assert text_of(f"<article><p>{LONG}</p><p><a href=/x>See the map</a></p></article>{MENU}") == f"{LONG}\nSee the map"
    assert text_of(f"<p>{LONG}</p><p>{LONG}</p><h3>Most read</h3>{MENU}") == f"{LONG}\n{LONG}"
