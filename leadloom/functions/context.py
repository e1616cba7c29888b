"""What the page evaluator sees: cut text, path ledger, prompt."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cut_observation(text: Column, max_chars: int) -> Column:
    return F.left(text, F.lit(max_chars))


def ledger_entry(depth: Column, url: Column) -> Column:
    return F.concat(F.lit("["), depth.cast("string"), F.lit("] "), url)


def add_to_ledger(ledger: Column, depth: Column, url: Column) -> Column:
    return F.array_append(ledger, ledger_entry(depth, url))


def annotate_last(ledger: Column, summary: Column) -> Column:
    """Append a note to the last entry; earlier entries stay as they are."""
    n = F.size(ledger)
    last = F.concat(F.element_at(ledger, -1), F.lit(" -> [Note: "), summary, F.lit("]"))
    return F.when(n > 0, F.concat(F.slice(ledger, F.lit(1), n - 1), F.array(last))).otherwise(ledger)


def path_context(ledger: Column, max_chars: int) -> Column:
    """The last ``max_chars`` characters of the path; 0 keeps the whole path."""
    joined = F.array_join(ledger, "\n")
    return joined if max_chars == 0 else F.right(joined, F.lit(max_chars))


def _tagged(tag: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>\n"), body, F.lit(f"\n</{tag}>"))


def evaluation_prompt(profile: Column, intent: Column, as_of: Column, memory: Column, url: Column,
                      text: Column) -> Column:
    return F.concat_ws(
        "\n",
        _tagged("context", profile), _tagged("context", intent), F.date_format(as_of, "MMMM yyyy"),
        _tagged("scratchpad", memory), url, _tagged("document", text),
    )
