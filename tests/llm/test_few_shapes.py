from gritmill.llm.stuffing import FEW_SHAPES, spam_share, stuffed

# Keywords of one line and one shape, each fewer than two times on average.
ONE_SHAPE = "scanner price scanner free license key scanner price lint tool cheap lint tool review compliance report license key compliance sheet cheap audit review"


def unlike(i: int) -> str:
    """A link line whose shape no other number below 20 has."""
    words = [("Abc" if k < i // 5 else "abc") + "de" for k in range(4)]
    return " ".join(words) + " 7" * (i % 5) + f" https://a.example/{i} https://b.example/{i}"


def test_one_shape_of_keywords_fills_the_page():
    assert 1.5 <= spam_share(ONE_SHAPE)[2] < 2 and stuffed(ONE_SHAPE)
    assert not stuffed("Please review the access rules for admin users of the billing service")


def test_many_shapes_do_not():
    page = "\n".join(unlike(i) for i in range(20))
    share, shapes, _ = spam_share(page)
    assert shapes == 20 and share < 0.5 and not stuffed(page)
    assert stuffed("\n".join(unlike(i % FEW_SHAPES) for i in range(20)))
