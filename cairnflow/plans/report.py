"""Summaries and reports as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lead_summary() -> Column:
    """A sentence or two on a lead of (entity, rank, n_ranked, n_addresses, score, tier, p, low, high, chips): who, how high, how likely,
    and why. Deterministic."""
    percent = lambda c: F.format_string("%.0f%%", 100 * c)
    where = F.when(F.col("rank") == 0, "is a known seed (not ranked as a new lead) with").otherwise(F.concat(F.lit("ranks #"), F.col("rank").cast("string"), F.lit(" of "), F.col("n_ranked").cast("string"), F.lit(" with")))
    head = F.concat(
        F.lit("E-"), F.col("entity").cast("string"), F.lit(" ("), F.col("n_addresses").cast("string"), F.when(F.col("n_addresses") == 1, " address) ").otherwise(" addresses) "), where,
        F.lit(" priority "), F.format_string("%.0f", F.col("score")), F.lit("/100 ("), F.upper("tier"), F.lit("). Model likelihood "), percent(F.col("p")), F.lit(" (90% range "), percent(F.col("low")), F.lit("-"), percent(F.col("high")), F.lit(")."),
    )
    why = F.when(F.size("chips") > 0, F.concat(F.lit(" Why it was flagged: "), F.array_join(F.slice("chips", 1, 3), "; "), F.lit("."))).otherwise("")
    return F.concat(head, why, F.lit(" This is a triage lead, not proof of wrongdoing."))


def markdown(title: str, tables: dict[str, list[dict]]) -> str:
    """A report with a table for each section; numbers to three digits, missing values as n/a."""
    show = lambda v: "n/a" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    out = [f"# {title}"]
    for name, rows in tables.items():
        out += ["", f"## {name}", ""]
        if not rows:
            out.append("No rows.")
            continue
        heads = list(rows[0])
        out += ["| " + " | ".join(heads) + " |", "|" + "-|" * len(heads)]
        out += ["| " + " | ".join(show(r.get(h)) for h in heads) + " |" for r in rows]
    return "\n".join(out) + "\n"
