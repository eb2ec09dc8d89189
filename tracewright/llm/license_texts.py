"""Wordings of licences: one-line notices, the paragraphs of usual headers, and whole licence files."""

from __future__ import annotations

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:"""
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:"""
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_1 = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_2 = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""


def _gpl(name: str, versions: str) -> list[str]:
    return [
        f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free
        Software Foundation, either {versions} of the License, or (at your option) any later version.""",
        f"""This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.""",
        f"""You should have received a copy of the {name} along with this program. If not, see https://www.gnu.org/licenses/.""",
    ]


_FAMILIES = [("GPL-2.0", "GNU General Public License", "version 2", "Version 2, June 1991"), ("GPL-3.0", "GNU General Public License", "version 3", "Version 3, 29 June 2007"), ("LGPL-3.0", "GNU Lesser General Public License", "version 3", "Version 3, 29 June 2007"), ("AGPL-3.0", "GNU Affero General Public License", "version 3", "Version 3, 19 November 2007")]
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = [
    "This is free and unencumbered software released into the public domain.",
    """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
    binary, for any purpose, commercial or non-commercial, and by any means.""",
    """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
    software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
    successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
    under copyright law.""",
]

#: (licence, wording). Fixed, so the vocabulary is bounded.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted free of charge to any person obtaining a copy of this software under the MIT License"),
    ("Apache-2.0", "Licensed under the Apache License Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms with or without modification are permitted under the BSD License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License version 3"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License version 2.0"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 licence CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("proprietary", "All rights reserved"),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0")),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_WARRANTY),
    ("MIT", "\n".join(["MIT License Copyright (c)", _MIT_GRANT, _MIT_NOTICE, _MIT_WARRANTY])),
    ("BSD-2-Clause", "\n".join(["BSD 2-Clause License Copyright (c) All rights reserved.", _BSD_GRANT, _BSD_1, _BSD_2, _BSD_WARRANTY])),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", "\n".join(["BSD 3-Clause License Copyright (c) All rights reserved.", _BSD_GRANT, _BSD_1, _BSD_2, _BSD_3, _BSD_WARRANTY])),
    ("ISC", _ISC_GRANT),
    ("ISC", "\n".join(["ISC License Copyright (c)", _ISC_GRANT, _ISC_WARRANTY])),
    ("Apache-2.0", _APACHE_1),
    ("Apache-2.0", _APACHE_2),
    ("Apache-2.0", "\n".join([_APACHE_1, _APACHE_2])),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    *((key, part) for key, name, version, _ in _FAMILIES for part in (lambda p: [*p[:1], "\n".join(p)])(_gpl(name, version))),
    *((key, f"{name} {title}") for key, name, _, title in _FAMILIES),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *(("Unlicense", part) for part in (_UNLICENSE[0], "\n".join(_UNLICENSE))),
]
