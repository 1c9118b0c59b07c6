"""Pages in disguised words and pages of sentences in form only; texts of the tests' own writing."""

import pytest

from gritmill.llm import stuffing
from gritmill.llm.stuffing import echo, plain_words, shape, stuffed

DISGUISED = [
    " ~ ".join(["G A R D E N   H O S E", "g4rd3n h053", "garden_hose", "★ garden hose", "GARDEN HOSE"] * 3),
    "  ".join(["ch34p 7yr35", "C H E A P   T Y R E S", "cheap_tyres", "★ cheap tyres"] * 5),
    "\n".join(["★ P I Z Z A   O F E N ★ pizza_ofen ★ p1zz4 0f3n ★ PIZZA OFEN ★ pizza_ofen ★"] * 4),
]
REFRAINS = [
    "Rent a beach villa now, since a beach villa beats every other beach villa. " * 2,
    "Our roof repair is the best roof repair for any roof repair client. Love roof repair? This roof repair is the roof repair you want.",
    "Antivirus buyers trust antivirus, so get antivirus today. This antivirus is the antivirus that other antivirus fans want.",
    "Holen Sie Gartenzaun Bausatz, denn Gartenzaun Bausatz ist besser als Holz. Wer Gartenzaun Bausatz sucht, findet Gartenzaun Bausatz nur hier.",
    "租车服务就是最好的租车服务，比任何租车服务都好。想要租车服务，就选租车服务。",
]
FINE = [
    "Until the release, the release captain will block the route at the gateway.",
    "The cache keeps the old cache key, so a stale cache entry may win. The job that fills it runs each night and logs what it dropped.",
    "v1.2.3 f81c15c9 d859aaab 33cb39c5 fixed in build 1729",
    "return user_name\nyield order_list\nglobal item_count",
    "Please check s3cr3t handling in auth_service before the next review.",
    "https://a.example/one",
    "Home",
]


@pytest.mark.parametrize("text", DISGUISED + REFRAINS)
def test_found(text):
    assert stuffed(text)


@pytest.mark.parametrize("text", FINE)
def test_left(text):
    assert not stuffed(text)


def test_disguises_are_read():
    assert plain_words("G A R D E N   H O S E ~ g4rd3n h053").split() == ["GARDEN", "HOSE", "|", "garden", "hose"]
    assert plain_words("F-044007 CWE-89 1.2.3") == "F-044007 CWE-89 1.2.3"


def test_an_echo_is_within_one_sentence():
    words = "the release captain blocks the route".split()
    assert echo(" ".join(words), words, 0)[0] == 0
    assert shape("Roof repair clients love roof repair, so choose roof repair now.")[0] == "refrain"


def test_the_shapes_decide(monkeypatch):
    page = "\n".join(" ".join([("Abc" if k < i // 5 else "abc") + "de" for k in range(4)]) + " 7" * (i % 5) + f" https://a.example/{i} https://b.example/{i}" for i in range(20))
    assert not stuffed(page)
    plain = stuffing.shape
    monkeypatch.setattr(stuffing, "shape", lambda u: (plain(u)[0], (0,) * 8, *plain(u)[2:]))
    assert stuffed(page)
