import pytest

from gritmill.llm.stuffing import spam_share, stuffed

ITEMS = "Sitemap,Login,import probe,Home,picker,cursor,invoice,harbor writer,hook,review proxy,index reducer,Next".split(",")


@pytest.mark.parametrize("mark", [" / ", " | ", " » ", " · ", " > "])
def test_menu_needs_no_repetition(mark):
    assert stuffed(mark.join(ITEMS))


def test_enumerations_and_tables_are_no_menus():
    prose = "It touches parser, picker, cursor store, invoice job, harbor writer, hook, review proxy, index reducer"
    table = "| relay | high | open | mine | yours | late | early |"
    for text in (prose, table):
        assert spam_share(text)[0] == 0 and not stuffed(text)
