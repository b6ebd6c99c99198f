"""An interactive session (V18): verbs refine the last ranked result; a status filter sticks until it is lifted."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from lorebase.functions.constants import DONE
from lorebase.operators import rank, resolve
from lorebase.operators.filters import Filters, parse_list


class Session:
    def __init__(self, corpus: DataFrame, encode, n: int = 10):
        self.corpus, self.encode, self.n = corpus, encode, n
        self.filters, self.last, self._again = Filters(), None, None

    def do(self, line: str) -> DataFrame | None:
        """`like T`, `tags a,b`, `more N`, `n N`, `completed`, `any`, or free text."""
        verb, _, rest = line.strip().partition(" ")
        rest = rest.strip()
        if verb in ("completed", "any") and not rest:
            self.filters = replace(self.filters, status=DONE if verb == "completed" else None)
            return self._run()
        if verb == "n" and rest.isdigit():
            self.n = int(rest)
            return self._run()
        if verb == "more" and rest.isdigit():
            return self._seed(self._nth(int(rest)))
        if verb == "like" and rest:
            hit = resolve.resolve_title(self.corpus, rest).select("url").first()
            return self._seed(hit.url if hit else None)
        if verb == "tags" and rest:
            self._again = lambda: rank.tag_listing(self.corpus, sorted(parse_list(rest)), self.n, self.filters.status)
        elif line.strip():
            self._again = lambda: rank.query(self.corpus, line.strip(), self.encode, self.n, self.filters)
        return self._run()

    def _nth(self, i: int) -> str | None:
        rows = self.last.select("url").limit(i).collect() if self.last is not None else []
        return rows[i - 1].url if 0 < i <= len(rows) else None

    def _seed(self, url: str | None) -> DataFrame | None:
        if url is None:
            return None
        self._again = lambda: rank.like(self.corpus, url, self.n, self.filters)
        return self._run()

    def _run(self) -> DataFrame | None:
        self.last = self._again() if self._again else None
        return self.last


def post_process(ranked: DataFrame, order: DataFrame | None, explain, query_text: str, text_col: str = "synopsis", top_k: int = 20) -> DataFrame:
    """Rerank the first rows, then explain those without a reason."""
    from pyspark.sql import functions as F

    out = rank.rerank(ranked, order, top_k) if order is not None else ranked.withColumn("reason", F.lit(None).cast("string"))
    return out.withColumn("reason", F.coalesce("reason", rank.explain_column(explain, query_text)(text_col))) if explain else out
