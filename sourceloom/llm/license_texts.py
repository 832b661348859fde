"""Templates of the license scan: full texts, usual notices and short references of the common licenses.

A template is a wording. Where one wording serves several licenses or versions, its ``tells`` say which: the
words of a tell must stand in the place without a gap, and those of ``also``, if any, near them.
The long texts lie as files beside this module and are read on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Tell:
    license: str
    phrase: str
    also: str = ""


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    tells: tuple[Tell, ...] = ()


_GNU = (
    ("GPL", "gnu general public license", ("1", "2", "3")),
    ("LGPL", "gnu lesser general public license", ("2.1", "3")),
    ("LGPL", "gnu library general public license", ("2", "2.1")),
    ("AGPL", "gnu affero general public license", ("1", "3")),
)


def _dotted(version: str) -> str:
    return version if "." in version else f"{version}.0"


#: Version named after the name of the license, and before "of the ... License".
GNU_AFTER = tuple(
    Tell(f"{i}-{_dotted(v)}", f"{name} {mark} {v}") for i, name, vs in _GNU for v in vs for mark in ("version", "v")
)
GNU_BEFORE = tuple(
    Tell(f"{i}-{_dotted(v)}", f"version {v} of the", name) for i, name, vs in _GNU for v in vs
)
_CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: (identifier, names). Names of several versions stand in full, since a name is matched in full.
NAMES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0")),
    ("Apache-1.1", ("Apache License, Version 1.1", "Apache Software License, Version 1.1")),
    ("MIT", ("MIT License", "MIT licence", "Expat License")),
    ("MIT-0", ("MIT No Attribution License",)),
    ("ISC", ("ISC License",)),
    ("0BSD", ("Zero-Clause BSD License", "BSD Zero Clause License")),
    ("BSD", ("BSD License", "BSD licence", "BSD-style license")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-clause BSD License", "Simplified BSD License", "FreeBSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-clause BSD License", "New BSD License", "Modified BSD License")),
    ("Unlicense", ("Unlicense", "Unlicense License")),
    ("Zlib", ("zlib License", "zlib/libpng License")),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("WTFPL", ("Do What The Fuck You Want To Public License",)),
    ("MPL-2.0", ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0")),
    ("MPL-1.1", ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1")),
    ("EPL-1.0", ("Eclipse Public License 1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License v1.0")),
    ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v. 2.0")),
    ("CC0-1.0", ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal")),
    ("Artistic-2.0", ("Artistic License 2.0",)),
    *(
        (f"{i}-{_dotted(v)}", (f"{name}, version {v}", f"{name} v{v}", f"{name} v {v}", f"{name} {v}", f"{i} {v} license", f"{i}v{v}", f"{i}-{_dotted(v)}"))
        for i, name, vs in _GNU
        for v in vs
    ),
    *(
        (f"CC-{k}-{v}", (f"CC {k} {v}", f"Creative Commons {name} {v}"))
        for k, name in _CC.items()
        for v in _CC_VERSIONS
    ),
)
#: What stands before a name; verbs before "under" do not matter.
_LEADS = ("under", "terms of")
_WORDS = re.compile(r"[A-Za-z0-9]+")


def _short() -> list[Template]:
    out = {}
    for license, names in NAMES:
        for name in names:
            for lead in _LEADS:
                for the in ("", "the ", "a ") if name.startswith("Creative") else ("", "the "):
                    text = f"{lead} {the}{name}"
                    # a shingle is three words
                    heads = ("licensed ", "released ", "distributed ", "available ") if len(_WORDS.findall(text)) < 3 else ("",)
                    for head in heads:
                        out[f"{head}{text}".lower()] = Template(license, head + text, (Tell(license, head + text),))
        out[f"spdx {license}"] = Template(license, f"SPDX-License-Identifier: {license}", (Tell(license, f"license identifier {license}"),))
    return list(out.values())


_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO'
    " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
    " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
    " DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without'
    " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
    " the Software"
)
_MIT_MORE = ", and to permit persons to whom the Software is furnished to do so"
_MIT_KEEP = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included"
    " in all copies or substantial portions of the Software."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = (
    '. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
    " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
    " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
    " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE"
    " USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met"
)
_BSD_KEEP = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the"
    " following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution."
)
_BSD_NAME = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE"
    " USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,"
    " use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
    " purpose, commercial or non-commercial, and by any means."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
    " liable for any damages arising from the use of this software. Permission is granted to anyone to use this software"
    " for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the"
    " following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you"
    " wrote the original software. If you use this software in a product, an acknowledgment in the product documentation"
    " would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not"
    " be misrepresented as being the original software. 3. This notice may not be removed or altered from any source"
    " distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
    ' accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,'
    " execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties"
    " to whom the Software is furnished to do so, all subject to the following"
)
_HEADER = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the {2} as published by"
    " the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
    " with the License. You may obtain a copy of the License at"
)
_APACHE_TELLS = (Tell("Apache-2.0", "apache license version 2"), Tell("Apache-1.1", "apache license version 1"))
_CC_TELLS = tuple(
    Tell(f"CC-{k}-{v}", f"creative commons {name} {v} {end}")
    for k, name in _CC.items()
    for v in _CC_VERSIONS
    for end in ("international", "unported", "generic", "license")
)
#: The first ten keep their numbers.
_NOTICES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", _APACHE_TELLS),
    Template("Apache-2.0", _APACHE, _APACHE_TELLS),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", GNU_AFTER),
    Template(
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
        GNU_BEFORE,
    ),
    Template("MIT", "Released under the MIT License.", (Tell("MIT", "under the mit license"),)),
    Template("MIT", _MIT),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", (Tell("CC-BY-NC-4.0", "under cc by nc 4 0"),)),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", _CC_TELLS),
    Template("BSD", _BSD),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", (Tell("MPL-2.0", "public license v 2 0"),)),
    Template("MIT", _MIT + _MIT_MORE + _MIT_KEEP + _WARRANTY, (Tell("MIT", "this permission notice shall be included"),)),
    Template("MIT-0", _MIT + _MIT_MORE + "." + _WARRANTY, (Tell("MIT-0", "furnished to do so the software is provided"),)),
    Template("ISC", _ISC + _ISC_KEEP + _ISC_END, (Tell("ISC", "this permission notice appear in all copies"),)),
    Template("0BSD", _ISC + _ISC_END, (Tell("0BSD", "fee is hereby granted the software is provided"),)),
    Template("BSD-2-Clause", _BSD + _BSD_KEEP + _BSD_END),
    Template("BSD-3-Clause", _BSD + _BSD_KEEP + _BSD_NAME + _BSD_END, (Tell("BSD-3-Clause", "to endorse or promote products derived"),)),
    Template("Unlicense", _UNLICENSE),
    Template("Zlib", _ZLIB),
    Template("BSL-1.0", _BOOST),
    *(
        Template(i, _HEADER.format(what, mark, name), GNU_BEFORE)
        for what, mark in (("program", ";"), ("library", ";"))
        for i, name in (("GPL-2.0", "GNU General Public License"), ("LGPL-2.1", "GNU Lesser General Public License"), ("LGPL-2.0", "GNU Library General Public License"), ("AGPL-3.0", "GNU Affero General Public License"))
    ),
    *(Template(f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.", _CC_TELLS) for k, name in _CC.items() if k != "BY"),
)
#: Texts that stand for more than one version, or that have a sibling with nearly the same text, are told by their words.
_TEXTS = {
    "Apache-2.0": ("Apache-2.0", ()),
    "Artistic": ("Artistic-1.0", ()),
    "CC0-1.0": ("CC0-1.0", ()),
    "GFDL-1.2": ("GFDL-1.2", (Tell("GFDL-1.2", "version 1.2 november 2002"),)),
    "GFDL-1.3": ("GFDL-1.3", (Tell("GFDL-1.3", "version 1.3 3 november 2008"),)),
    "GPL-1": ("GPL-1.0", ()),
    "GPL-2": ("GPL-2.0", ()),
    "GPL-3": (
        "GPL-3.0",
        (
            Tell("GPL-3.0", "use with the gnu affero general public license"),
            Tell("AGPL-3.0", "remote network interaction use with the gnu general public license"),
        ),
    ),
    "LGPL-2": ("LGPL-2.0", ()),
    "LGPL-2.1": ("LGPL-2.1", ()),
    "LGPL-3": ("LGPL-3.0", ()),
    "MPL-1.1": ("MPL-1.1", ()),
    "MPL-2.0": ("MPL-2.0", ()),
}


def every() -> tuple[Template, ...]:
    here = Path(__file__).parent / "licenses"
    full = [Template(i, (here / f"{f}.txt").read_text(encoding="utf-8"), tells) for f, (i, tells) in _TEXTS.items()]
    return (*_NOTICES, *full, *_short())
