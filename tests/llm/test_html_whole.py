"""Pages that leave out </head>, or whose containers only look like asides, keep their text."""

import pytest

from helixframe.llm import html


def kept(page):
    return [t for _, k, t in html.blocks(page) if k]


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><meta charset=utf-8><body><p>All of it</p></body></html>",
    "<head><title>T</title><p>All of it",
    "<head><script>var a</script><div>All of it</div>",
    "<html><head><link rel=x>All of it",
    "<body><div class='layout-with-sidebar'><p>All of it</p></div><div class='sidebar'>no</div><nav>no</nav>",
    "<body><div class='content has-comments'><p>All of it</p></div><div class='cookie-banner'>no</div>",
    "<body><div class='post no-sidebar'><p>All of it</p></div><div id='footer'>no</div>",
    "<body><form action=x><nav>no</nav><article><p>All of it</p></article><button>no</button></form>",
    "<body><form action=x><p>All of it</p><select><option>no</select></form>",
    "<body><div class='widget'><p>no</p><main><p>All of it</p><aside>no</aside></main></div>",
    "<body><article><p>All of it</p></article><div class='related'><article><p>no</p></article></div>",
    "<html><head><title>no</title></head><body><p>All of it</p><div class='comments'><p>no</p></div>",
])
def test_nothing_else_is_dropped(page):
    assert kept(page) == ["All of it"]
