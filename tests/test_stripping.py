from hypothesis import given
from hypothesis import strategies as st

from loomgraph.functions.languages import Language, by_name, omission_comment, register_language
from loomgraph.functions.stripping import strip_rows, stripper


def line(lang, text):
    return stripper(by_name(lang)).line(text)


def whole(lang, text):
    return stripper(by_name(lang)).whole(text)


def test_nested_comments_keep_lines():
    assert whole("rust", "a /* x /* y */\n z */ b\nc") == "a \n b\nc"


def test_opener_in_string_is_text():
    assert whole("c-family", 'f("/*"); g();\nh(); /* i\n */ j();') == 'f("/*"); g();\nh(); \n j();'


def test_raw_strings_and_lifetimes():
    assert line("c-family", 'x = R"d(a " // b)d"; y') == "x = ; y"
    assert line("rust", "fn f<'a>(x: &'a str, c = 'b') // d") == "fn f<'a>(x: &'a str, c = ) "


def test_multiline_strings():
    assert whole("python", 's = """a\nfoo()\n"""\nbar()') == "s = \n\n\nbar()"
    assert line("go", "x := `a // b` + c // d") == "x :=  + c "


def test_batch_comments():
    assert line("batch", "echo a REM b") == "echo a "
    assert line("batch", ":: all") == ""
    assert line("batch", "call :remove") == "call :remove"


def test_blanked_keeps_offsets():
    s = stripper(by_name("c-family"))
    assert s.blanked("a /* b */ c // d") == "a         c     "


def test_omission_comment():
    assert omission_comment(by_name("c-family"), "x") == "/* ... [x] ... */"
    assert omission_comment(by_name("python"), "x") == "# ... [x] ..."


def test_registered_language():
    register_language(Language("ruby", (".rb",), "#", None))
    assert line("ruby", "a # b") == "a "


@given(st.text(alphabet="ab\"'/*\n #`{}", max_size=60), st.sampled_from(["python", "rust", "c-family", "go", "javascript", "java"]))
def test_line_count_is_kept(text, lang):
    assert whole(lang, text).count("\n") == text.count("\n")
    assert len(strip_rows(text, lang)) == (text.count("\n") + 1 if text else 0)
