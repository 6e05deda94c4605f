"""Licence scan on notices that are not among its templates, and on the odd rows of the contract."""

import pytest
from pyspark.sql import functions as F

from diurna.llm import license_scan as L

#: Notices as they are met elsewhere: other wording, wrapped, marked up, tags.
HELD_OUT = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"),
    ("mit", "The code in this repository is licensed under the MIT License, see LICENSE."),
    ("mit", "// SPDX-License-Identifier: MIT"),
    ("mit", "*This software* is licensed\nunder the **MIT License**."),
    ("apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", "Copyright 2019 The Authors\n\nLicensed under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except in\ncompliance with the License. You may obtain a copy"),
    ("apache-2.0", " * Licensed under the Apache License, Version 2.0\n * (the \"License\"); you may not use this file except\n * in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with\nor without modification, are permitted provided that the\nfollowing conditions are met:\n1. Redistributions of source code must retain the notice"),
    ("bsd", "/* SPDX-License-Identifier: BSD-3-Clause */"),
    ("gpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl", "This work is licensed under the GNU General Public\nLicense, version 3."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1 or later."),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("agpl", "The server is licensed under the GNU Affero General Public License, version 3 or any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0\nInternational License. To view a copy visit the site."),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    ("cc-by-nc", "All pictures: licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all\ncopyright and related or neighboring rights to this work."),
    ("cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("all-rights-reserved", "**All** **rights** **reserved**"),
    ("all-rights-reserved", "© 2021 Some Publisher Ltd. All rights reserved worldwide."),
    ("all-rights-reserved", "No part of this publication may be reproduced in any\nform without the prior written permission of the\npublisher, except for short quotations."),
]
CLEAN = [
    "This software is not licensed under the MIT License.", "The tool is not released under the BSD license, ask the owner.",
    "This project was not licensed under the Apache License, Version 2.0.", "He renewed his driving license and the rest was history.",
    "The committee reserved the right to speak.", "A public library is free for all citizens.\nIt is open on Sundays.", "MIT and BSD were mentioned in the talk.",
]


@pytest.fixture(scope="module")
def model():
    return L.fit([f"plain line number {i} about the weather of the day" for i in range(300)] + CLEAN[3:])


@pytest.fixture(scope="module")
def cues(model):
    return set().union(*(L.cues_of(p) for own in model.pairs.values() for p in own))


def test_held_out_notices(model, cues):
    before, after = "An opening line of the document.\nAnother one.\n\n", "\n\nAnd the text goes on for some more lines.\nThe end."
    right = [f for f, t in HELD_OUT if {x["family"] for x in L.found_in(before + t + after, model, cues)[1]} == {f}]
    assert len(right) >= 0.9 * len(HELD_OUT), [f for f, _ in HELD_OUT if f not in right]
    assert [x for t in CLEAN for x in L.found_in(before + t + after, model, cues)[1]] == []


def test_the_filter_loses_nothing(model, cues):
    # against every line and every block without the filter
    for _, t in [*HELD_OUT, *L.NOTICES, *((None, c) for c in CLEAN)]:
        everything = L.found_in(t, model, set(L.words_of(t)))
        assert L.found_in(t, model, cues) == everything


def test_odd_rows(spark, model):
    notice = "Released under the MIT License."
    long = "word of the text " * 50_000
    texts = [None, "", " \n\n", notice, notice, long + "\n" + notice, long + notice, "\n".join(["a line of it"] * 20_000) + "\n" + notice]
    docs = spark.createDataFrame([(i if i != 4 else 3, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("n_paragraphs", "families", "family", "found", "line", "h")})
    rows = L.scan(docs, model).collect()
    got = sorted((r.doc_id, r.n_paragraphs, tuple(r.families)) for r in rows)
    assert got[:5] == [(0, 0, ()), (1, 0, ()), (2, 0, ()), (3, 1, ("mit",)), (3, 1, ("mit",))]
    assert got[5][1:] == (2, ("mit",)) and got[7][1:] == (20_001, ("mit",)) and got[6][1] == 1
    assert L.scan(docs.limit(0), model).collect() == []


def test_the_sample_is_the_lines_of_smallest_hash(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {i} {k}" for k in range(50)) + "\n" + "x" * 5000) for i in range(100)], "doc_id long, text string")
    every = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter("length(line) <= 2000").orderBy(F.xxhash64("line"), "line")
    assert L.corpus_lines(docs, 40) == [r.line for r in every.limit(40).collect()]
    assert len(L.corpus_lines(docs, 10_000)) == 5_000 and L.corpus_lines(docs.limit(0), 5) == []
