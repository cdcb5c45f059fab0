import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilgraph.functions import jsontext, paths, pieces, pseudonyms
from veilgraph.operators import mapping, textops
from veilgraph.plans import tables

SALT = "00" * 16


def shown(own):
    return "".join(t if c is None else f"-A<{t}>" if c == "arc" else "-" + t.rpartition("-")[2] if c == "kept_arc" else f"<{c}|{t}>" for c, t in own)


@pytest.mark.parametrize(
    "form, value, keep, out",
    [
        ("sid", "S-1-5-21-1-2-3-1104", False, "<sids|S-1-5-21-1-2-3>-A<S-1-5-21-1-2-3-1104>"),
        ("sid", "S-1-5-21-1-2-3-512", True, "<sids|S-1-5-21-1-2-3>-512"),
        ("sid", "CORP.LOCAL-S-1-5-32-544", True, "<domains|corp>.LOCAL-S-1-5-32-544"),
        ("sid", "s-1-5-32-544", False, "<sids|S-1-5-32-544>"),
        ("domain", "a..Net", False, "<domains|a>..Net"),
        ("domain", "local", False, "<domains|local>"),
        ("guid", " {ABCDEF00-0000-0000-0000-000000000000} ", False, "{<guids|abcdef00-0000-0000-0000-000000000000>}"),
        ("machine", "PC1$", False, "<accounts|PC1>$"),
        ("address", "a@b@c", False, "<accounts|a>@<domains|b@c>"),
        ("dn", r"CN=Doe\, J,OU=X+L=Y,DC=corp,DC=com", False, r"CN=<accounts|Doe\, J>,OU=<accounts|X>+L=<opaque|Y>,DC=<domains|corp>,DC=com"),
        ("dn", "DC=local", False, "DC=<domains|local>"),
        ("spn", "MSSQLSvc/db.corp.local:SAGE", False, "MSSQLSvc/<hosts|db>.<domains|corp>.local:<accounts|SAGE>"),
        ("spn", "nonsense", False, "<opaque|nonsense>"),
        ("group_at", "Admins@PC1", True, "Admins@<hosts|pc1>"),
        ("shape", "1.3.6.1", False, "<oids|1.3.6.1>"),
        ("opaque", "x", False, "<opaque|x>"),
    ],
)
def test_pieces(form, value, keep, out):
    assert shown(mapping.cut(form, value, None, keep)) == out


def test_numbers_and_strings_survive():
    text = '{"b": 1.50, "a": [1e3, -0, 123456789012345678901234567890123456789012345], "é": "\\u0007\\"\\\\/\u007f😀", "e": {}, "l": []}'
    out = jsontext.dumps(jsontext.parse(text))
    assert out == '{"b": 1.50, "a": [1e3, -0, 123456789012345678901234567890123456789012345], "\\u00e9": "\\u0007\\"\\\\/\\u007f\\ud83d\\ude00", "e": {}, "l": []}'
    assert jsontext.dumps(jsontext.parse('{"b": {"d": 1, "c": []}, "a": 2}'), sort=True, indent=2) == json.dumps({"a": 2, "b": {"c": [], "d": 1}}, indent=2)
    for bad in ("NaN", '"\\ud800"', "[1,]"):
        with pytest.raises(ValueError):
            jsontext.parse(bad)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=4)), min_size=1, max_size=7))
def test_paths_read_back(own):
    path = ""
    for s in own:
        path = paths.index_step(path, 7) if s is None else paths.key_step(path, s)
    assert paths.steps(path) == own
    assert paths.canonical(path) == paths.canonical(paths.canonical(path))


def test_malformed_paths():
    for bad in ("a.", "a[", "a[x]", 'a["b]', "a..b"):
        with pytest.raises(ValueError):
            paths.steps(bad)


def test_pseudonyms_depend_on_identity_alone():
    p = pseudonyms.pseudonym
    assert p(SALT, "accounts", "Alice") == p(SALT, "accounts", "aLICE") != p("11", "accounts", "alice")
    assert p(SALT, "guids", "{AB000000-0000-0000-0000-000000000000}") == p(SALT, "guids", "ab000000000000000000000000000000")
    assert p(SALT, "oids", "1.02.3") == p(SALT, "oids", "1.2.3") and p(SALT, "opaque", "A") != p(SALT, "opaque", "a")
    assert p(SALT, "domains", "x.test").endswith(".test") and p(SALT, "domains", "x.corp").endswith(".local")
    assert pseudonyms.arc(SALT, "S-1-5-21-1-2-3-9") != "9"


def test_tables():
    own = tables.rules()
    tables.check_rules(own)
    assert len(own) == 195 and len(tables.catalog()) == 149 and len(tables.SYSTEMS) == 130
    assert len(tables.rules(tables.Config(preserve_os_strings=False))) == 195
    with pytest.raises(ValueError):
        tables.check_rules([*own, own[0]])
    with pytest.raises(ValueError):
        tables.check_rules([tables.Rule("x", "a", "replace_opaque", node_types=())])
    assert "administrators" in tables.core_names() and "alice" not in tables.core_names()


def test_scrub_and_restore():
    own = textops.Text([("domains", "contoso", "contoso-4aisw7g6lyfdm"), ("accounts", "Alice", "zfoo1"), ("accounts", "straße", "zbar2"), ("opaque", "Secret", "[REDACTED:abc]"), ("oids", "1.2.3", "2.25.7")])
    text, counts, unresolved = own.scrub("ALICE saw alicex, CONTOSO; Secret secret 1.2.3 STRASSE contoso-4aisw7g6lyfdm")
    assert text == "zfoo1 saw alicex, contoso-4aisw7g6lyfdm; [REDACTED:abc] secret 2.25.7 zbar2 contoso-4aisw7g6lyfdm"
    assert counts == {"accounts": 2, "domains": 1, "opaque": 1, "oids": 1} and not unresolved
    assert own.scrub(text)[0] == text
    assert own.restore("xzfoo1! [REDACTED:abc]") == "xAlice! Secret"


def test_sweep():
    assert textops.sweep("Bob bobby BOB, ann", {"bob": "X", "ann": "Y"}) == "X bobby X, Y"
    assert textops.distinct_ignoring_case(["a", "A", "b"]) == ["a", "b"] and textops.token_pattern([]) is None


def test_tokens_ignoring_case():
    assert [textops.signature(c) for c in ("I", "İ", "ı", "ſ", "K", "ς", "ẞ")] == [("i",), ("i",), ("i",), ("s",), ("k",), ("σ",), ("ss",)]
    assert textops.signature("ﬆ") == textops.signature("ﬅ") and textops.one_spelling("ﬆẞΰCafÉ") == "ﬅßΰcafé"
    assert textops.distinct_ignoring_case(["İ", "ı", "ß", "ss"]) == ["i", "ß", "ss"]
    assert textops.find_tokens("Bob bobby BOB", ["bob", "Bobby x"]) == {"Bob", "BOB"} and textops.find_tokens("a", []) == set()
    assert textops.sweep("BOB and Bo", {"Bob": "X", "bob": "Y", "bo": "Z"}) == "X and Z"
