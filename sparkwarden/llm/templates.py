"""Wordings of common licences: whole texts of the short ones, notices and openings of the long ones, and sentences by which files declare them.
The whole texts of the long ones are in texts/.

Fixed values: the licences' own words and the SPDX identifiers.
"""

from __future__ import annotations

import pkgutil

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
NAMES = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}


def notices(short: str, version: str) -> list[tuple[str, str]]:
    """What files say of a licence of the GNU family: the notice with its usual endings, the title, and short sentences."""
    name, number = NAMES[short], version.removesuffix(".0")
    start = f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
    texts = [
        f"{start}, either version {number} of the License, or (at your option) any later version.", f"{start}, version {number}.", f"{name} Version {number}", f"Licensed under the {name}, version {number}.",
        f"This work is licensed under the {name}, version {number}.", f"Released under the {short} version {number}.", f"Licensed under {short}v{number}.",
    ]
    return [(f"{short}-{version}", t) for t in texts]


#: Identifier and wording. A name without a version stands for its latest one.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "The MIT License (MIT)"), ("MIT", MIT.split("\n")[0]), ("MIT", MIT), ("MIT", f"MIT License\n{MIT}"),
    ("ISC", "ISC License"), ("ISC", ISC.split("\n")[0]), ("ISC", ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", APACHE.split(".")[0]), ("Apache-2.0", APACHE), ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", NAMES["GPL"]), *notices("GPL", "3.0"), *notices("GPL", "2.0"), ("LGPL-3.0", NAMES["LGPL"]), *notices("LGPL", "3.0"), *notices("LGPL", "2.1"), ("AGPL-3.0", NAMES["AGPL"]), *notices("AGPL", "3.0"),
    ("BSD-2-Clause", f"{BSD_HEAD}\n{BSD_TAIL}"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", BSD_HEAD.split("\n")[0]), ("BSD-3-Clause", f"{BSD_HEAD}\n{BSD_THIRD}\n{BSD_TAIL}"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."), ("MPL-2.0", MPL), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Zlib", ZLIB), ("Unlicense", UNLICENSE), ("Unlicense", UNLICENSE.split("\n")[0]), ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International"), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"), ("CC0-1.0", "Licensed under CC0 1.0."), ("proprietary", "All rights reserved."),
]
SPDX = "MIT ISC Apache-2.0 GPL-3.0 GPL-2.0 LGPL-3.0 LGPL-2.1 AGPL-3.0 BSD-2-Clause BSD-3-Clause MPL-2.0 Zlib Unlicense EPL-2.0 BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0".split()
TEMPLATES += [(k, f"SPDX-License-Identifier: {k}{end}") for k in SPDX for end in (("", "-only", "-or-later") if "GPL" in k else ("",))]


#: The long licences, and where what follows their terms begins.
LONG = {
    "Apache-2.0": "APPENDIX: How to apply", "MPL-2.0": "Exhibit A - Source Code Form", "GPL-2.0": "END OF TERMS AND CONDITIONS", "GPL-3.0": "END OF TERMS AND CONDITIONS",
    "LGPL-2.1": "END OF TERMS AND CONDITIONS", "LGPL-3.0": "", "CC0-1.0": "",
}


def long_texts() -> list[tuple[str, str]]:
    """Each long licence whole, and without what follows its terms. The Affero licence is that of version 3 of its family under its own name."""
    out = []
    for name, end in LONG.items():
        text = pkgutil.get_data(__package__, f"texts/{name}.txt").decode()
        out += [(name, text)] + ([(name, text.split(end)[0])] if end else [])
    affero = [("AGPL-3.0", t.replace("General Public License", "Affero General Public License").replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC")) for n, t in out if n == "GPL-3.0"]
    return out + affero
