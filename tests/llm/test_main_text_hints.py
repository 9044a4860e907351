import pytest

from codeloupe.llm import main_text as m


@pytest.mark.parametrize("attributes", [' title="A hidden valley"', ' data-teaser="the hidden cost"', ' data-id="menu-3"', ' title="id=menu"', ' class="formatted"', ' class="noticeable"', ' class="headerless"'])
def test_no_chrome(attributes):
    assert m.hints("p", attributes) == (0.0, False)


@pytest.mark.parametrize("attributes", [" hidden", ' hidden=""', ' title="x" hidden', " aria-hidden='true'", ' STYLE="display: none"', " id=menu-3", ' class="site header-top"', ' class="notice"', ' class="contact-form"', ' role = "navigation"', ' hidden/'])
def test_chrome(attributes):
    assert m.hints("p", attributes)[1]
