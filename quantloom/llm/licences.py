"""Licence scan by sentence rules: sentences become identifiers, identifier sequences are matched against ordered rules.

A text is normalised (lower case, runs of other signs than a-z and 0-9 become one space, marks for line and sentence ends). A known licence sentence is found
where it fills the text between two marks; line ends inside it do not matter, so hard-wrapped notices are found too. The identifiers found, in the order of the text, are matched against the rules: a rule holds when its sentences follow each other in
that sequence. All of it is column expressions; nothing is shuffled.

Defined results: null or empty text, or a text without a known sentence, has no sentence and no licence (empty strings, 0); a repeated sentence counts each
time; ``licence`` is the first rule that holds in the order of the rules, ``licences`` all of them. Other columns pass through, columns of the same names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers and sentences of public licence notices, normalised.
SENTENCES = [
    ("cc-by-nc-4", "licensed under cc by nc 4 0"),
    ("cc-by-4", "licensed under cc by 4 0"),
    ("cc-by-sa-4", "licensed under cc by sa 4 0"),
    ("gpl-3-work", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2-work", "this work is licensed under the gnu general public license version 2"),
    ("apache-2-under", "licensed under the apache license version 2 0"),
    ("apache-2-the-license", "licensed under the apache license version 2 0 the license"),
    ("apache-2-comply", "you may not use this file except in compliance with the license"),
    ("apache-2-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit-released", "released under the mit license"),
    ("mit-title", "the mit license"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("public-domain", "this work is in the public domain"),
    ("reserved", "all rights reserved"),
]

# Rules in order, the more exact first; each is a licence and the sentences that must follow each other.
RULES = [
    ("apache-2.0", ("apache-2-the-license", "apache-2-comply")),
    ("apache-2.0", ("apache-2-under",)),
    ("mit", ("mit-title", "mit-notice")),
    ("mit", ("mit-released",)),
    ("mit", ("mit-notice",)),
    ("bsd", ("bsd-source", "bsd-binary")),
    ("gpl-3.0", ("gpl-3-work",)),
    ("gpl-3.0-or-later", ("gpl-free",)),
    ("gpl-2.0", ("gpl-2-work",)),
    ("cc-by-nc-4.0", ("cc-by-nc-4",)),
    ("cc-by-sa-4.0", ("cc-by-sa-4",)),
    ("cc-by-4.0", ("cc-by-4",)),
    ("public-domain", ("public-domain",)),
    ("all-rights-reserved", ("reserved",)),
]

# More sentences of public licence notices. The SQL of ``oracle`` covers the first list only.
FURTHER = [
    ("mit-title", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2-copy", "you may obtain a copy of the license at"),
    ("gpl-free-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v"),  # 'v. 2.0' ends a sentence
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license version 2 0"),
    ("cc0-waived", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cc0-under", "licensed under cc0 1 0"),
    ("cc0-title", "cc0 1 0 universal"),
] + [
    (f"lgpl-free-{version.replace(' ', '.')}", f"this {work} is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {version} of the license or at your option any later version")
    for version in ("2 1", "3") for work in ("library", "program")
]

# Rules of these sentences.
FURTHER_RULES = [
    ("mit", ("mit-grant",)),
    ("isc", ("isc-grant",)),
    ("gpl-2.0-or-later", ("gpl-free-2",)),
    ("agpl-3.0-or-later", ("agpl-free",)),
    ("lgpl-2.1-or-later", ("lgpl-free-2.1",)),
    ("lgpl-3.0-or-later", ("lgpl-free-3",)),
    ("mpl-2.0", ("mpl-2",)),
    ("cc0-1.0", ("cc0-waived",)),
    ("cc0-1.0", ("cc0-under",)),
    ("cc0-1.0", ("cc0-title",)),
]

ALL_SENTENCES = SENTENCES + FURTHER
ALL_RULES = RULES[:-2] + FURTHER_RULES + RULES[-2:]  # the two that many notices of other licences also hold stay last


def normal(text: Column) -> Column:
    """Words with one space between, ``N`` for line ends and ``S`` for sentence ends, at both ends of the text too."""
    out = F.translate(F.regexp_replace(F.lower(text), "[.!?]+[ \\t\\r\\n]+", "S"), "\n", "N")
    out = F.concat(F.lit("S"), F.regexp_replace(out, "[^a-z0-9NS]+", " "), F.lit("S"))
    return F.regexp_replace(F.regexp_replace(out, " ?N[ N]*", "N"), "[ N]?S[ NS]*", "S")


def scan(docs: DataFrame, text: str = "text", sentences=ALL_SENTENCES, rules=ALL_RULES) -> DataFrame:
    """Add ``n_sentences``, ``sentence_ids``, ``licence`` and ``licences``."""
    known = F.create_map(*[F.lit(x) for ident, sentence in sentences for x in (sentence, ident)])
    # the shorter first: a line that is a sentence counts as such, whatever follows it
    any_known = "|".join(s.replace(" ", "[ N]") for s in sorted((s for _, s in sentences), key=len))
    held_sentences = F.regexp_extract_all(normal(F.col(text)), F.lit(f"(?<=[NS])(?:{any_known})(?=[NS])"), F.lit(0))
    found = F.transform(held_sentences, lambda s: F.try_element_at(known, F.translate(s, "N", " ")))
    out = docs.withColumn("_ids", F.coalesce(found, F.array().cast("array<string>")))
    line = F.concat(F.lit(","), F.concat_ws(",", "_ids"), F.lit(","))
    held = F.array_compact(F.array(*[F.when(F.contains(line, F.lit("," + ",".join(need) + ",")), F.lit(name)) for name, need in rules]))
    return (
        out.withColumn("n_sentences", F.size("_ids").cast("long"))
        .withColumn("sentence_ids", F.concat_ws(",", "_ids"))
        .withColumn("_held", F.array_distinct(held))
        .withColumn("licence", F.coalesce(F.try_element_at("_held", F.lit(1)), F.lit("")))
        .withColumn("licences", F.concat_ws(",", "_held"))
        .drop("_ids", "_held")
    )


def oracle(sentences=SENTENCES, rules=RULES) -> str:
    """The scan of ``documents`` as DuckDB SQL."""
    cases = " ".join(f"when '{s}' then '{i}'" for i, s in sentences)
    held = ", ".join(f"case when contains(line, ',{','.join(need)},') then '{name}' end" for name, need in rules)
    ranks = " ".join(f"when '{name}' then {k}" for k, name in reversed(list(enumerate(dict.fromkeys(n for n, _ in rules)))))
    cut = "[.!?]+[ \\t\\r\\n]+|\\n"
    return f"""
with s as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{cut}'),
    lambda x: case trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) {cases} end), lambda y: y is not null) as ids from documents),
l as (select *, ',' || array_to_string(ids, ',') || ',' as line from s),
h as (select doc_id, ids, list_transform(list_sort(list_distinct(list_transform(list_filter([{held}], lambda x: x is not null), lambda x: case x {ranks} end))),
    lambda k: [{", ".join(f"'{n}'" for n in dict.fromkeys(n for n, _ in rules))}][k + 1]) as held from l)
select doc_id, cast(len(ids) as bigint) as n_sentences, array_to_string(ids, ',') as sentence_ids,
  coalesce(held[1], '') as licence, array_to_string(held, ',') as licences from h
"""
