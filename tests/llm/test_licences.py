from quarry.llm.licences import licences

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in it.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."

CASES = {
    None: "",
    "": "",
    "A page about a permission slip. Nothing more.": "",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Some words.\nThis work is licensed under the GNU General Public License, version 3.": "GPL-3-only",
    "Released under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "All rights reserved.": "Proprietary",
    "No dot before\nReleased under the MIT License.": "MIT",
    "Released under the MIT License. Released under the MIT License. Licensed under the Apache License, Version 2.0.": "Apache-2.0,MIT",
    MIT: "MIT",
    GPL: "GPL-2-or-later",
    "Licensed under the Frobnicate License.": "Unknown",
    "It is licensed\tunder the  APACHE license version 1.1": "Apache-1.1",
    "word " * 50000 + ". Released under the MIT License.": "MIT",
}


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id long, text string, licences string")
    got = {r.doc_id: r.licences for r in licences(df).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())


def test_wrapped_header(spark):
    row = licences(spark.createDataFrame([(1, APACHE)], "doc_id long, text string")).first()
    assert "ApacheWarranty" in row.sentence_ids and "ApacheSee" in row.sentence_ids


def test_empty_table(spark):
    assert licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""
LGPL = """ * This library is free software;
 * you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation;
 * either version 2.1 of the License, or (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
HEADERS = {
    APACHE: "Apache-2.0",
    APACHE.replace("# ", "").replace("\n#\n", "\n\n"): "Apache-2.0",
    APACHE.replace("at\n#\n#     http", "at http"): "Apache-2.0",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': "Apache-2.0",
    "// Copyright 2020 Someone\n// SPDX-License-Identifier: Apache-2.0\nimport os\n": "SPDX-APACHE-2.0",
    "/* SPDX-License-Identifier: GPL-2.0-only */\nint main;": "SPDX-GPL-2.0-ONLY",
    "# SPDX-License-Identifier: GPL-2.0+\nx = 1": "SPDX-GPL-2.0-OR-LATER",
    "SPDX-License-Identifier: MIT\nSome words": "SPDX-MIT",
    GPL2: "GPL-2-or-later",
    LGPL: "LGPL-2.1-or-later",
    MPL: "MPL-2.0",
    "This work is licensed under the GNU General Public License v. 2.": "GPL-2-only",
    "Available under CC BY 4.0.": "CC-BY-4.0",
    "Placed into the public\n# domain.": "PublicDomain",
}


def test_standard_headers(spark):
    df = spark.createDataFrame(list(enumerate(HEADERS)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences(df).collect()}
    assert [got[i] for i in range(len(HEADERS))] == list(HEADERS.values())


ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
"""
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.\n'
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.

"""
BSD3 = BSD2 + """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software.

"""
#: Public notices and the heads of licence files, with what they mean, written down by hand.
NOTICES = {
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n": "Apache-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n": "GPL-3",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n": "GPL-2",
    "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n": "LGPL-3",
    "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n": "AGPL-3",
    "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n": "MPL-2.0",
    "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM": "EPL-2.0",
    "/* All rights are as follows. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at\n * http://www.eclipse.org/legal/epl-v10.html */": "EPL-1.0",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.": "CDDL",
    "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0\n\n1. Definitions.\n": "CDDL-1.0",
    ZLIB: "Zlib",
    ISC: "ISC",
    BSD2: "BSD-2-Clause",
    BSD3: "BSD-3-Clause",
    "                 The Artistic License 2.0\n\n           Copyright (c) 2000-2006, The Perl Foundation.\n": "Artistic-2.0",
    "This library is free software; you can redistribute it and/or modify\nit under the same terms as Perl itself.\n": "Artistic-1.0-Perl OR GPL-1.0-or-later",
    "            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n                    Version 2, December 2004\n\n": "WTFPL",
    " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.\n": "GPL-2-only",
    "Licensed under the GNU Affero General Public License v3.0.": "AGPL-3.0-only",
    "Distributed under the MIT license (see LICENSE).": "MIT",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)": "BSL-1.0",
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy": "Unlicense",
    "This work is dedicated to the public domain under the CC0 1.0 Universal license.": "CC0-1.0",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-ATTRIBUTION-SHAREALIKE-4.0",
    "You may get the drug only with a prescription and a driving permit.": "",
}


def test_public_notices(spark):
    df = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.sentence_ids) for r in licences(df).collect()}
    wrong = {i: (text, want, got[i]) for i, (text, want) in enumerate(NOTICES.items()) if got[i][0] != want}
    assert not wrong



def test_long_sentences_take_linear_time(spark):
    import time

    rows = [(i, t) for i, t in enumerate(["no warranty here " + "word " * 200_000, "distributed under " * 50_000, "you should have received a copy of the gnu " * 20_000, "Distributed under these terms, " + "word " * 1000 + "of a licence"])] * 2
    began = time.perf_counter()
    got = {r.doc_id: r.sentence_ids for r in licences(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert time.perf_counter() - began < 60 and got == {0: "", 1: "", 2: "", 3: "LicenceOther"}
