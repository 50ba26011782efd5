"""License scans with DataFrame and SQL functions only.

Texts are cut into lower-case words of letters and digits and hashed five-word shingles. Templates fall in
classes by size; for a class of up to s shingles the windows have s + stride - 1 shingles and start every
``stride`` ones, so one window holds any run of s. A template with 0.8 of its shingles in its window has a
Jaccard similarity of 0.3 or more with it, and 32 bands of one min-hash miss it with probability under
1.2e-5 (a one-shingle template's windows are single shingles, which never miss). A window's band can only
equal a template's if the window holds the very shingle that is the template's minimum there, so min-hashes
are taken only for windows with such a shingle: the same matches at a fraction of the work. Retrieved
windows are verified by exact containment of the template's shingles.

Edge cases: null, empty and under-five-word texts match nothing; rows with equal or null ids are counted
together; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices and opening texts of public licenses, as their stewards publish them, and one-line forms.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "boost-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-nc-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "zlib-grant": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
WORDS = 5
BANDS = 32


def shingles(df: DataFrame, text: str = "text") -> DataFrame:
    """Add h, the hashes of all five-word shingles in order."""
    clean = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "))
    gram = ", ".join(f"w[i + {k}]" for k in range(WORDS))
    hashes = F.expr(f"if(size(w) >= {WORDS}, transform(sequence(0, size(w) - {WORDS}), i -> xxhash64({gram})), cast(array() as array<bigint>))")
    return df.withColumn("w", F.split(clean, " ")).withColumn("h", hashes).drop("w")


def _signature(col: str) -> str:
    return "array(" + ", ".join(f"array_min(transform({col}, x -> xxhash64(x, {k}L)))" for k in range(BANDS)) + ")"


def prepared(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Each template's shingles, class size and signature, computed by the same expressions (a small table)."""
    df = shingles(spark.createDataFrame(sorted(templates.items()), "license_id string, text string"))
    rows = df.select("license_id", F.array_distinct("h").alias("h")).where("size(h) > 0").withColumn("sig", F.expr(_signature("h"))).collect()
    out = []
    for r in rows:
        size = 1
        while size < len(r.h):
            size *= 2
        out.append({"license_id": r.license_id, "h": list(r.h), "size": size, "sig": list(r.sig)})
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80) -> DataFrame:
    """(doc_id, license_id, containment, first_word, n_windows): templates found in each text.

    containment is the best window's share of the template's shingles, first_word where the first
    matching window starts (from 0), n_windows how many windows match.
    """
    spark = docs.sparkSession
    known = prepared(spark, templates or TEMPLATES)
    flat = spark.createDataFrame([(t["license_id"], t["size"], t["h"], t["sig"]) for t in known], "license_id string, size int, th array<bigint>, sig array<bigint>")
    # The shingle that gives each band's minimum: only windows that hold one can share a band.
    least = F.expr("array(" + ", ".join(f"xxhash64(x, {k}L) = sig[{k}]" for k in range(BANDS)) + ")")
    keys: dict[int, set[int]] = {}
    for r in flat.select("size", "sig", F.explode("th").alias("x")).where(F.array_contains(least, True)).select("size", "x").distinct().collect():
        keys.setdefault(r["size"], set()).add(r["x"])
    listed = lambda s: ", ".join(f"{x}L" if x != -(2**63) else "(-9223372036854775807L - 1L)" for x in sorted(s))
    every = listed(set().union(*keys.values()))

    parts = []
    for size, own in sorted(keys.items()):
        stride = max(1, size // 4)
        width = size + stride - 1
        starts = f"sequence(greatest(0, (i - {width} + {stride}) div {stride}), i div {stride})"
        parts.append(f"array_distinct(flatten(transform(filter(hits, i -> h[i] in ({listed(own)})), i -> transform({starts}, k -> struct({size} as size, cast(k * {stride} as int) as start, {width} as width)))))")
    hits = F.expr(f"if(size(h) > 0, filter(sequence(0, size(h) - 1), i -> h[i] in ({every})), cast(array() as array<int>))")
    found = shingles(docs.select("doc_id", "text")).select("doc_id", "h").withColumn("hits", hits)
    # explode_outer, then a filter on its output: an inner explode would push a copy of the whole
    # computation below as a filter.
    windows = found.select("doc_id", "h", F.explode_outer(F.expr(f"flatten(array({', '.join(parts)}))")).alias("at")).where("at is not null")
    windows = windows.select("doc_id", "at.size", "at.start", F.expr("slice(h, at.start + 1, at.width)").alias("win"))
    bands = windows.select("*", F.posexplode_outer(F.expr(_signature("win"))).alias("band", "low"))
    wanted = flat.select(F.col("license_id"), F.col("size").alias("s"), "th", F.posexplode("sig").alias("b", "l"))
    met = bands.join(F.broadcast(wanted), (F.col("size") == F.col("s")) & (F.col("band") == F.col("b")) & (F.col("low") == F.col("l")))
    share = F.size(F.array_intersect("win", "th")) / F.size("th")
    sure = met.select("doc_id", "license_id", "start", share.alias("share")).where(F.col("share") * 100 >= percent)
    once = sure.groupBy("doc_id", "license_id", "start").agg(F.max("share").alias("share"))
    return once.groupBy("doc_id", "license_id").agg(F.max("share").alias("containment"), F.min("start").alias("first_word"), F.count(F.lit(1)).alias("n_windows"))
