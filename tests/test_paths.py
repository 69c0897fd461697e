import pytest

from quern.errors import InvalidPath
from quern.functions.paths import display, parse_path


@pytest.mark.parametrize(
    ("path", "segments"),
    [
        ("", ()), ("a", ("a",)), ("a.b", ("a", "b")), ("a[0].b", ("a", 0, "b")), ('a["x-y"].c', ("a", "x-y", "c")), ("[2][3]", (2, 3)), ("a[0].", ("a", 0)),
        ("a b.c-d", ("a b", "c-d")),
    ],
)
def test_parse(path, segments):
    assert parse_path(path) == segments


@pytest.mark.parametrize("path", ["a.", ".a", "a..b", "a[", "a[x]", "a[-1]", 'a["b', 'a["b"', "a[1"])
def test_refused(path):
    with pytest.raises(InvalidPath):
        parse_path(path)


def test_display():
    assert display(()) == "(root)"
    assert display(("a", 0, "b")) == "a[0].b"
