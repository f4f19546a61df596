"""Licence texts and notices to compare with. The wording of the licences, by SPDX identifier."""

from __future__ import annotations

_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies."
)
_ISC_REST = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. "
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
    "For more information, please refer to <https://unlicense.org>"
)
_BOSTON = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_FSF = "Copyright (C) Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(subject: str, license_name: str, version: str) -> str:
    """The notice that the GNU licences propose for the head of a source file."""
    return (
        f"This {subject} is free software; you can redistribute it and/or modify it under the terms of the GNU {license_name} as published by the "
        f"Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    )


#: Whole texts of short licences, compared with whole files; of texts that are as near, the first counts.
WHOLE = (
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD} {_BSD_REST}"),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) All rights reserved. {_BSD_GRANT} {_BSD_TWO} {_BSD_REST}"),
    ("MIT", f"MIT License Copyright (c) {_MIT_GRANT} {_MIT_REST}"),
    ("ISC", f"ISC License Copyright (c) {_ISC_GRANT} {_ISC_REST}"),
    ("Unlicense", _UNLICENSE),
)

#: How the long licence texts begin, compared with the first words of a file.
HEADS = (
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION "
        '1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    ),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 1989 {_BOSTON} {_FSF} Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_FSF} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    (
        "AGPL-3.0",
        f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 {_FSF} Preamble The GNU Affero General Public License is a free, copyleft license for "
        "software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    (
        "LGPL-2.1",
        f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 1991 {_BOSTON} {_FSF} This is the first released version of the Lesser GPL. It also counts as the "
        "successor of the GNU Library Public License, version 2, hence the version number 2.1.",
    ),
    (
        "LGPL-3.0",
        f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_FSF} This version of the GNU Lesser General Public License incorporates the terms and "
        "conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ),
    (
        "MPL-2.0",
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation '
        'of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor',
    ),
    (
        "CC0-1.0",
        "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS "
        "DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP.",
    ),
    *(
        (
            f"CC-{short}-4.0",
            f"{name} 4.0 International Creative Commons Corporation is not a law firm and does not provide legal services or legal advice. Distribution of Creative "
            "Commons public licenses does not create a lawyer-client or other relationship.",
        )
        for short, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"))
    ),
)

_SPDX = (
    *("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    *("GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-or-later", "ISC", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense"),
)

#: Notices, compared with lines, sentences and paragraphs.
NOTICES = (
    ("BSD-3-Clause", _BSD_THIRD),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
        'the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the '
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        "language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", _BSD_GRANT),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", _gnu("program", "General Public License", "2")),
    ("GPL-3.0-or-later", _gnu("program", "General Public License", "3")),
    ("AGPL-3.0-or-later", _gnu("program", "Affero General Public License", "3")),
    ("LGPL-2.1-or-later", _gnu("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0-or-later", _gnu("library", "Lesser General Public License", "3")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("ISC", _ISC_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((name, f"SPDX-License-Identifier: {name}") for name in _SPDX),
)
