"""Known licences: how notices name them, their full texts and header notices. Fixed values."""

from __future__ import annotations

from pathlib import Path

#: SPDX id: names under which notices know the licence.
NAMES = {
    "MIT": ("MIT License", "the MIT License", "The MIT License (MIT)", "the MIT licence"),
    "Apache-2.0": (
        "Apache License 2.0",
        "the Apache License, Version 2.0",
        "the Apache 2.0 License",
        "Apache 2.0",
    ),
    "GPL-2.0": (
        "the GNU General Public License, version 2",
        "the GNU General Public License v2.0",
        "GPLv2",
    ),
    "GPL-3.0": (
        "the GNU General Public License, version 3",
        "the GNU General Public License v3.0",
        "GPLv3",
    ),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License"),
    "ISC": ("the ISC License",),
    "Zlib": ("the zlib License",),
    "Unlicense": ("the Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": (
        "CC BY-SA 4.0",
        "a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC-BY-NC-4.0": (
        "CC BY-NC 4.0",
        "a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-ND-4.0": (
        "CC BY-ND 4.0",
        "a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ),
}
#: Forms of a notice around a name.
FORMS = (
    "Licensed under {}",
    "Released under {}",
    "Distributed under {}",
    "Published under {}",
    "Available under {}",
    "License: {}",
    "This work is licensed under {}",
    "This file is licensed under {}",
    "This project is licensed under {}",
    "This software is licensed under {}",
    "This software is released under {}",
    "This program is licensed under {}",
)
IDENTIFIER_FORMS = ("SPDX-License-Identifier: {}", "License: {}")

FULL = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: Title lines that may stand above a full text.
TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("", "ISC License"),
    "BSD-2-Clause": ("", "BSD 2-Clause License"),
    "Zlib": ("", "zlib License"),
}


def known() -> list[tuple[str, str]]:
    """(SPDX id, text) of every known notice and full text."""
    out = [(i, form.format(n)) for i, names in NAMES.items() for n in names for form in FORMS]
    out += [(i, form.format(i)) for i in NAMES for form in IDENTIFIER_FORMS]
    out += [(i, f"{title}\n\n{FULL[i]}") for i, titles in TITLES.items() for title in titles]
    return out


#: Full texts kept as files, one for each SPDX id.
FOLDER = Path(__file__).resolve().parent / "license_data"
#: Known by names and notices only: no full text of these ships with the package.
NAMES_ONLY = ("AGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0")
#: Texts are also handed on without what follows this line (how to apply the licence).
END = "END OF TERMS AND CONDITIONS"

THIRD_CLAUSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD_3_TITLES = (
    "", "BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License",
    "New BSD License", "Modified BSD License",
)

APACHE_LINES = (
    'Licensed under the Apache License, Version 2.0 (the "License");',
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
)
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    {}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at {}://mozilla.org/MPL/2.0/."""

#: (SPDX id, name, version) of the licences with the notice of the GNU project.
GNU = (
    ("GPL-2.0", "GNU General Public License", "2"),
    ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
)
#: Punctuation folds alike, so a comma stands for a semicolon too.
GNU_GRANT = """This program is free software: you can redistribute it and/or modify
it under the terms of the {} as published by
the Free Software Foundation{}"""
GNU_VERSIONS = (
    ", either version {0} of the License, or\n(at your option) any later version.",
    ", version {0} of the License.",
    ", version {0}.",
)
GNU_WARRANTY = """

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{} for more details.
"""
GNU_COPY = """
You should have received a copy of the {}
along with this program.  If not, see <{}://www.gnu.org/licenses/>."""


def more() -> list[tuple[str, str]]:
    """(SPDX id, text) of the full texts and header notices beyond ``known``."""
    out = []
    for path in sorted(FOLDER.glob("*.txt")):
        text = path.read_text()
        out.append((path.stem, text))
        if END in text:
            out.append((path.stem, text[: text.index(END) + len(END)]))
            out.append((path.stem, text[: text.index(END)]))
    two = FULL["BSD-2-Clause"]
    three = two.replace("THIS SOFTWARE IS", THIRD_CLAUSE + "THIS SOFTWARE IS", 1)
    out += [("BSD-3-Clause", f"{title}\n\n{three}") for title in BSD_3_TITLES]
    out += [("Apache-2.0", line) for line in APACHE_LINES]
    for web in ("http", "https"):
        out += [("Apache-2.0", APACHE_NOTICE.format(web)), ("MPL-2.0", MPL_NOTICE.format(web))]
    for i, name, version in GNU:
        for form in GNU_VERSIONS:
            grant = GNU_GRANT.format(name, form.format(version))
            warranty = GNU_WARRANTY.format(name)
            out += [(i, grant), (i, grant + warranty)]
            out += [(i, grant + warranty + GNU_COPY.format(name, web)) for web in ("http", "https")]
    return out
