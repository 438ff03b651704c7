"""Assemble a query from the common table expressions it names."""

from __future__ import annotations

import re


def compose(body: str, parts: dict[str, str]) -> str:
    """``body`` preceded by the parts it uses, directly or through other parts."""
    needed: list[str] = []

    def add(sql: str) -> None:
        for name, part in parts.items():
            if name not in needed and re.search(rf"\b{name}\b", sql):
                add(part)
                if name not in needed:
                    needed.append(name)

    add(body)
    ctes = ",\n".join(f"{name} AS (\n{parts[name].strip()}\n)" for name in needed)
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()


def share(part: str, total: str) -> str:
    """Percentage of two whole amounts, half up to two places; NULL over zero."""
    return (
        f"CAST(CAST((20000 * CAST({part} AS HUGEINT) + CAST({total} AS HUGEINT))"
        f" // nullif(2 * CAST({total} AS HUGEINT), 0) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2))"
    )


def average(total: str, n: str, unit: int = 1) -> str:
    """Mean of ``n`` values whose sum is ``total / unit``, half up to two places."""
    return (
        f"CAST(CAST((200 * CAST({total} AS HUGEINT) + {unit} * CAST({n} AS HUGEINT))"
        f" // nullif(2 * {unit} * CAST({n} AS HUGEINT), 0) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2))"
    )


def money(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(22,0)) * 0.01 AS DECIMAL(25,2))"


def amount(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(17,0)) * 0.01 AS DECIMAL(15,2))"


def padded(number: str, width: int) -> str:
    text = f"CAST({number} AS VARCHAR)"
    return f"lpad({text}, CAST(greatest({width}, length({text})) AS INTEGER), '0')"
