"""Template names: a recursive-descent parser over C++ name text, as a column of arguments in postfix."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

ARGS = "name string, args array<array<struct<op:string,g:bigint,n:int,s:string>>>, error string"
# C++ builtin, its primitive. char and wchar_t come from the configuration.
BUILTIN = {
    "void": "void",
    "bool": "bool",
    "unsigned char": "u8",
    "unsigned short": "u16",
    "unsigned int": "u32",
    "unsigned long": "u64",
    "short": "i16",
    "int": "i32",
    "long": "i64",
    "float": "f32",
    "double": "f64",
}
CV = {"const", "volatile", "restrict", "__restrict", "struct", "class", "enum", "union", "typename"}


class Parser:
    """Tokens of one argument: BASE (a primitive or a name without templates), NAME (n templated arguments before it), CONST (value in g), PTR, ARRAY, SUB, PTMD, PTMF."""

    def __init__(self, text: str, char: str, wchar: str):
        self.text, self.at = text, 0
        self.builtin = BUILTIN | {"char": char, "wchar_t": wchar, "signed char": "i8", "long long": "i64", "unsigned long long": "u64", "unsigned": "u32"}

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at] == " ":
            self.at += 1

    def looks(self, s: str) -> bool:
        self.space()
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        if self.looks(s):
            self.at += len(s)
            return True
        return False

    def need(self, s: str) -> None:
        if not self.take(s):
            raise ValueError(f"no {s} at {self.at}")

    def word(self) -> str:
        self.space()
        start = self.at
        while self.at < len(self.text) and (self.text[self.at].isalnum() or self.text[self.at] in "_$~"):
            self.at += 1
        return self.text[start : self.at]

    def list_of(self, close: str, one) -> list:
        out: list = []
        if self.take(close):
            return out
        while True:
            out.append(one())
            if self.take(close):
                return out
            self.need(",")

    def argument(self) -> list[tuple]:
        self.space()
        rest = self.text[self.at :]
        if self.take("(") and not self.looks("anonymous"):  # a cast: (Enum)3
            depth = 1
            while depth and self.at < len(self.text):
                depth += {"(": 1, ")": -1}.get(self.text[self.at], 0)
                self.at += 1
            rest = self.text[self.at :]
        if rest[:1] == "-" or rest[:1].isdigit():
            negative = self.take("-")
            digits = self.word().lower().rstrip("ul")
            return [("CONST", (-1 if negative else 1) * int(digits, 0), None, None)]
        start = self.at
        word = self.word()
        if word in ("true", "false") and not self.looks("::"):
            return [("CONST", int(word == "true"), None, None)]
        self.at = start
        return self.type()

    def type(self) -> list[tuple]:
        out = self.named()
        while True:
            self.space()
            if self.take("&&") or self.take("&") or self.take("*"):
                out.append(("PTR", None, None, None))
            elif self.looks("["):
                self.need("[")
                out.append(("ARRAY", None, int(self.word()), None))
                self.need("]")
            elif self.looks("("):
                out = self.function(out)
            elif (at := self.at) is not None and (w := self.word()) in CV:
                continue
            elif w:
                self.at = at
                owner = self.named()
                if not self.take("::*"):
                    raise ValueError(f"unexpected {w} at {at}")
                out.append(("PTMD", None, None, self.single(owner)))
            else:
                return out

    @staticmethod
    def single(owner: list[tuple]) -> str:
        if len(owner) != 1:
            raise ValueError("the class of a pointer to member has templates")
        return owner[0][3]

    def function(self, ret: list[tuple]) -> list[tuple]:
        self.need("(")
        stars, owner = 0, None
        if self.looks("*") or self.looks("&"):
            while self.take("*") or self.take("&"):
                stars += 1
            self.need(")")
            self.need("(")
        else:
            at = self.at
            try:
                inner = self.named()
                if self.take("::*") and self.take(")") and self.take("("):
                    owner = self.single(inner)
                else:
                    self.at = at
            except ValueError:
                self.at = at
        args = self.list_of(")", self.type)
        if args == [[("BASE", None, None, "void")]]:
            args = []
        out = [*ret, *(t for a in args for t in a)]
        while self.word() in ("const", "volatile", "noexcept"):
            pass
        if owner is not None:
            return [*out, ("PTMF", None, 1 + len(args), owner)]
        return [*out, ("SUB", None, 1 + len(args), None), *[("PTR", None, None, None)] * stars]

    def named(self) -> list[tuple]:
        """A builtin or a qualified name, each segment with templates of its own; only the last segment's arguments are kept apart."""
        words = []
        while True:
            at = self.at
            w = self.word()
            if w in CV:
                continue
            if w in ("unsigned", "signed", "long", "short", "int", "char", "double") or (w in self.builtin and not words):
                words.append(w)
                continue
            self.at = at
            break
        if words:
            name = " ".join(x for x in words if x != "signed" or words == ["signed", "char"])
            name = {"long int": "long", "unsigned long int": "unsigned long", "short int": "short", "long unsigned int": "unsigned long", "": "int"}.get(name, name)
            if name not in self.builtin:
                raise ValueError(f"unexpected builtin {name}")
            return [("BASE", None, None, self.builtin[name])]
        path, args = [], []
        self.take("::")
        while True:
            if self.take("(anonymous namespace)"):
                seg = ""
            elif not (seg := self.word()):
                raise ValueError(f"no name at {self.at}")
            start, args = self.at, []
            if self.take("<"):
                args = self.list_of(">", self.argument)
            more = self.looks("::") and not self.looks("::*")
            path.append(seg + (self.text[start : self.at] if more else ""))
            if not more:
                break
            self.need("::")
        name = "::".join(x for x in path if x)
        return [*(t for a in args for t in a), ("NAME", None, len(args), name)] if args else [("BASE", None, None, name)]

    def whole(self) -> tuple[str, list[list[tuple]]]:
        path, args = [], []
        while True:
            if self.take("(anonymous namespace)"):
                seg = ""
            elif not (seg := self.word()):
                raise ValueError(f"no name at {self.at}")
            start, args = self.at, []
            if self.take("<"):
                args = self.list_of(">", self.argument)
            more = self.looks("::")
            path.append(seg + (self.text[start : self.at] if more else ""))
            if not more:
                break
            self.need("::")
        self.space()
        if self.at != len(self.text):
            raise ValueError(f"left over at {self.at}")
        return "::".join(x for x in path if x), args


def parser(char: str = "i8", wchar: str = "u32"):
    """A column function from name text to its untemplated name and its arguments; error says why a name can't be parsed."""

    @F.pandas_udf(ARGS)
    def parse(names: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in names:
            rows = []
            for text in b:
                try:
                    name, args = (None, None) if text is None else Parser(text, char, wchar).whole()
                    rows.append((name, None if args is None else [[{"op": o, "g": g, "n": n, "s": s} for o, g, n, s in a] for a in args], None))
                except (ValueError, IndexError) as e:
                    rows.append((None, None, str(e)))
            yield pd.DataFrame(rows, columns=["name", "args", "error"])

    return parse
