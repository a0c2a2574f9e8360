"""The few functions whose names differ between Spark SQL and DuckDB, so that a query and its check share one text."""

from __future__ import annotations

from collections.abc import Callable

SPARK, DUCK = "spark", "duck"


class Dialect:
    def __init__(self, name: str):
        self.name, self.spark = name, name == SPARK
        self.each = "explode" if self.spark else "unnest"
        self.size = "size" if self.spark else "len"
        self.text, self.distinct = ("STRING", "array_distinct") if self.spark else ("VARCHAR", "list_distinct")

    def pattern(self, p: str) -> str:
        return f"r'{p}'" if self.spark else f"'{p}'"

    def matches(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, {group})"

    def first(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def has(self, x: str, p: str) -> str:
        return f"regexp_like({x}, {self.pattern(p)})" if self.spark else f"regexp_matches({x}, '{p}')"

    def replaced(self, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}')" if self.spark else f"regexp_replace({x}, '{p}', '{by}', 'g')"

    def strip(self, x: str) -> str:
        return self.replaced(x, r"^[\x09-\x0D\x1C-\x20]+|[\x09-\x0D\x1C-\x20]+$", "")

    def normalized(self, x: str) -> str:
        """Line ends as LF, runs of blanks and tabs as one blank, at most one empty line, stripped, lower case."""
        lines = f"replace(replace({x}, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10))"
        blanks = self.replaced(self.replaced(lines, r"[ \x09]+", " "), r"\x0A{3,}", "\n\n")
        return f"lower({self.strip(blanks)})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def joined(self, x: str, order: str, sep: str = "|") -> str:
        """Texts of a group in an order."""
        if self.spark:
            return f"array_join(transform(sort_array(collect_list(struct({order} AS o, {x} AS x))), e -> e.x), '{sep}')"
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def joined_set(self, x: str, sep: str = ",") -> str:
        return f"array_join(sort_array(collect_set({x})), '{sep}')" if self.spark else f"string_agg(DISTINCT {x}, '{sep}' ORDER BY {x})"

    def micros(self, x: str) -> str:
        return f"unix_micros(CAST({x} AS TIMESTAMP))" if self.spark else f"epoch_us({x})"

    def words(self, x: str) -> str:
        """Lower-case ASCII words of two letters and more, at boundaries of any letter or digit."""
        found = self.matches(f"lower({x})", r"[\p{L}\p{N}_]+")
        return f"filter({found}, w -> w rlike '^[a-z]{{2,}}$')" if self.spark else f"list_filter({found}, lambda w: regexp_matches(w, '^[a-z]{{2,}}$'))"

    def tokens(self, x: str) -> str:
        return f"{self.distinct}({self.matches(f'lower({x})', '[a-z0-9]+')})"


Text = Callable[[Dialect], str]


class Registry(dict):
    """Queries by key: a text for a dialect."""

    def add(self, key: str) -> Callable[[Text], Text]:
        def keep(text: Text) -> Text:
            self[key] = text
            return text

        return keep

    def plain(self, **texts: str) -> None:
        """Texts that are the same in both."""
        for key, sql in texts.items():
            self[key] = lambda d, sql=sql: sql
