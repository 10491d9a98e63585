"""Licence notices found line by line: Dice coefficient over word bigrams against templates.

A text is cut into lines, a line into lower-case words of letters, digits and inner
dots or dashes.  A line and a template with ``a`` and ``b`` distinct word bigrams can
reach the coefficient ``2 |common| / (a + b) >= t`` only if ``a`` lies between
``b * t / (2 - t)`` and ``b * (2 - t) / t``; other templates are not compared.  The
templates are a fixed list of notices, so they stand in the plan as literals.  All of
it is column expressions in one pass without a shuffle.

Results for odd input: NULL and blank texts and lines of fewer than two words give no
rows; every line that matches gives one row with the best template (ties: the first
name); repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices under which works are commonly released.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "EPL-2.0": "Licensed under the Eclipse Public License, version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved. No part of this work may be reproduced without permission.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Least coefficient of a match.
DICE = 0.8

_WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1))


def bigrams(word_list: Column) -> Column:
    """Distinct pairs of neighbouring words; none for fewer than two words."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(word_list) - 1, F.lit(1))),
        lambda i: F.concat_ws(" ", F.get(word_list, i - 1), F.get(word_list, i)),
    )
    return F.when(F.size(word_list) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _template(name: str, notice: str) -> Column:
    """A literal: the same rule on the driver, since the plan would not fold it."""
    found = re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", notice.lower())
    pairs = dict.fromkeys(f"{a} {b}" for a, b in zip(found, found[1:]))
    return F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, pairs)).alias("pairs"))


def scan(docs: DataFrame, dice: float = DICE) -> DataFrame:
    """``(doc_id, line_no, license, dice)`` for every line that is close to a template."""
    templates = F.array(*[_template(n, t) for n, t in TEMPLATES.items()])
    bound = (2 - dice) / dice
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # An array of one that is taken apart keeps a costly expression from being put in again
    # wherever its value is used.
    cut = lines.select("doc_id", "line_no", F.explode(F.array(words(F.col("line")))).alias("w"))
    some = cut.where((F.size("w") > 1))
    pairs = some.select("doc_id", "line_no", F.explode(F.array(bigrams(F.col("w")))).alias("p"))
    share = lambda t: 2.0 * F.size(F.array_intersect("p", t["pairs"])) / (F.size("p") + F.size(t["pairs"]))
    fits = lambda t: F.size("p").between(F.size(t["pairs"]) / bound, F.size(t["pairs"]) * bound)
    scored = F.transform(
        F.filter(templates, fits), lambda t: F.struct((-share(t)).alias("s"), t["name"].alias("license"))
    )
    best = pairs.select("doc_id", "line_no", F.explode(F.array(F.array_min(scored))).alias("best"))
    return best.where(F.col("best.s") <= -dice).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "best.license", (-F.col("best.s")).alias("dice")
    )
