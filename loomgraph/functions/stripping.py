"""Comments and strings out of source text, as line-preserving scans."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import Language, by_name

_QUOTED = r"\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'"
_RUST_QUOTED = r"\"(?:[^\"\\\r\n]|\\.)*\"|'(?:\\[xX][0-9a-fA-F]{2}|\\u\{[0-9a-fA-F]{1,6}\}|\\.|[^'\\\r\n])'"
_RAW = {"cpp": r"\b(?:u8|u|U|L)?R\"(?P<cd>[^ ()\\\s]{0,16})\(.*?\)(?P=cd)\"", "rust": r"\b(?:br|cr|r)(?P<rh>\#*)\".*?\"(?P=rh)"}


class Stripper:
    """The scanners of one language: one alternation finds, from left to right, whatever can hide another's opener."""

    def __init__(self, language: Language):
        self.language = language
        wide = [_RAW[language.raw]] if language.raw else []
        wide += [rf"{re.escape(d)}(?:\\.|(?!{re.escape(d)}).)*{re.escape(d)}" for d in language.multiline]
        quoted = _RUST_QUOTED if language.lifetimes else _QUOTED
        open_ = [rf"{re.escape(d)}[^\r\n]*" for d in language.multiline]
        self.strings = re.compile("|".join([*wide, *open_, quoted]), re.S)
        kinds = [f"(?P<wide>{'|'.join(wide)})"] if wide else []
        kinds.append(f"(?P<quoted>{quoted})")
        if language.block:
            kinds.append(f"(?P<block>{re.escape(language.block[0])})")
        if language.line_comment:
            kinds.append(rf"(?P<line>{re.escape(language.line_comment)}[^\n]*)")
        self.scan = re.compile("|".join(kinds), re.S)
        if language.block:
            a, b = map(re.escape, language.block)
            self.inside = re.compile(f"(?P<open>{a})|(?P<close>{b})" if language.nested else f"(?P<close>{b})")

    def _block_end(self, text: str, at: int) -> int | None:
        """Where the block comment opened just before `at` ends; None if it never does."""
        depth = 1
        for m in self.inside.finditer(text, at):
            depth += 1 if m.lastgroup == "open" else -1
            if not depth:
                return m.end()
        return len(text) if self.language.nested else None

    def whole(self, text: str) -> str:
        """Block comments and strings over several lines replaced by their line ends; the number of lines stays."""
        out, at = [], 0
        while m := self.scan.search(text, at):
            end, kind = m.end(), m.lastgroup if m.lastgroup in ("quoted", "block", "line") else "wide"
            if kind == "block":
                end = self._block_end(text, m.end())
                if end is None:  # an opener without an end is text
                    out.append(text[at : m.end()])
                    at = m.end()
                    continue
            out.append(text[at : m.start()])
            gone = text[m.start() : end]
            out.append("\n" * gone.count("\n") if kind in ("block", "wide") else gone)
            at = end
        return "".join([*out, text[at:]])

    def line(self, text: str) -> str:
        """A line's code: no strings, no comments."""
        if self.language.name == "batch":
            return re.sub(r"(?i)(?:(?:^|&)\s*::|(?<![\w.])rem(?![\w.])).*$", "", _strings_out(re.compile(_QUOTED), text))
        text = _strings_out(self.strings, text)
        if self.language.block:
            at = 0
            while (start := text.find(self.language.block[0], at)) >= 0:
                mark = self.language.line_comment
                if mark and 0 <= text.find(mark, 0, start):
                    break
                end = self._block_end(text, start + len(self.language.block[0]))
                if end is None:
                    break
                text, at = text[:start] + text[end:], start
        mark = self.language.line_comment
        return text.split(mark, 1)[0] if mark else text

    def blanked(self, text: str) -> str:
        """A line with its comments blanked, so that offsets stay."""
        m = next((m for m in self.scan.finditer(text) if m.lastgroup in ("line", "block")), None)
        if not m:
            return text
        end = len(text) if m.lastgroup == "line" else self._block_end(text, m.end()) or len(text)
        return text[: m.start()] + " " * (end - m.start()) + self.blanked_from(text, end)

    def blanked_from(self, text: str, at: int) -> str:
        return self.blanked(" " * at + text[at:])[at:] if at < len(text) else ""


def _strings_out(pattern: re.Pattern, text: str) -> str:
    return pattern.sub(lambda m: "\n" * m.group().count("\n"), text)


@lru_cache(maxsize=64)
def stripper(language: Language) -> Stripper:
    return Stripper(language)


def strip_rows(content: str | None, lang: str) -> list[dict]:
    """Each line of a file as raw, stripped (whole-file pass) and clean (line pass too)."""
    if not content:
        return []
    s = stripper(by_name(lang))
    stripped = s.whole(content).split("\n")
    return [{"raw": r, "stripped": t, "clean": s.line(t)} for r, t in zip(content.split("\n"), stripped, strict=True)]


def strip_lines(content: Column, lang: Column) -> Column:
    """array<struct<raw, stripped, clean>> of a file's lines, in Arrow batches."""

    @F.pandas_udf("array<struct<raw:string,stripped:string,clean:string>>")
    def strip(contents: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([strip_rows(c, x) for c, x in zip(contents, langs, strict=True)])

    return strip(content, lang)
