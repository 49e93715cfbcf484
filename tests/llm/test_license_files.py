"""Licence files with their real full texts cover their directories."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses

COMMON = Path("/usr/share/common-licenses")
MIT = """MIT License

Copyright (c) 2020 A. Uthor

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
REAL = {"Apache-2.0": "Apache-2.0", "BSD-3-Clause": "BSD", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}


DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
BSD = """Copyright (c) 2020, A. Uthor

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
HEADERS = {
    "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
    "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n",
    "GPL-2.0": " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n"
    " * published by the Free Software Foundation.\n",
    "LGPL-2.1": "// This library is free software; you can redistribute it and/or\n// modify it under the terms of the GNU Lesser General Public\n"
    "// License as published by the Free Software Foundation; either\n// version 2.1 of the License, or (at your option) any later version.\n",
    "Apache-2.0": '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n',
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.\n", "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.\n", "CC-BY-4.0": "Licensed under CC BY 4.0.\n",
    "BSD-2-Clause": "// SPDX-License-Identifier: BSD-2-Clause\n", "EPL-2.0": "// SPDX-License-Identifier: EPL-2.0\n",
    "": "Licensed under CC BY-XX 9.0.\n# SPDX-License-Identifier: Unheard-Of-1.0\n# All rights reserved.\n",
}


def test_wrapped_headers_and_variants(spark):
    rows = [(k, f"{name or 'none'}/a.py", text + "\nimport os\n\nprint(os.name)\n") for k, (name, text) in enumerate(HEADERS.items())]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.path: r for r in licenses.scan(files, F.col("path")).collect()}
    assert {p: r.license for p, r in got.items()} == {f"{name or 'none'}/a.py": name for name in HEADERS}
    assert got["GPL-3.0/a.py"].score > 0.99 and got["GPL-3.0/a.py"].n_headers >= 2


def test_full_texts_cover(spark):
    texts = {"MIT": MIT, "BSD-2-Clause": BSD + DISCLAIMER, "BSD-3-Clause": BSD + THIRD + DISCLAIMER} | {k: (COMMON / f).read_text() for k, f in REAL.items() if (COMMON / f).exists()}
    if len(texts) < 2:
        pytest.skip("no licence texts on this machine")
    rows = [(f"{k}/LICENSE", t) for k, t in texts.items()] + [(f"{k}/src/lib/a.py", "x = 1") for k in texts]
    rows += [("note/about.txt", MIT), ("note/b.py", "y = 2")]  # not named as a licence
    files = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: r for r in licenses.scan(files, F.col("path")).collect()}
    for k in texts:
        r = got[f"{k}/src/lib/a.py"]
        assert (r.inherited, r.inherited_from, r.effective) == (k, k, k)
    assert got["note/b.py"].inherited == ""
