"""Templates of the common licenses: notices, name lines, SPDX lines and whole texts."""

from __future__ import annotations

from pathlib import Path

_GNU_TERMS = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_GNU = {
    "gpl": ("General Public License", ("1", "2", "3")),
    "lgpl": ("Lesser General Public License", ("2.1", "3")),
    "agpl": ("Affero General Public License", ("3",)),
}
_CC = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
#: Identifiers of SPDX lines.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-2-Clause-Patent "
    "BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 "
    "CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2 GFDL-1.3 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only "
    "GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 "
    "LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-3.0 "
    "Unlicense UPL-1.0 Vim WTFPL X11 Zlib"
).split()


def notices() -> dict[str, str]:
    """Notices that authors put into files, and lines that name a license."""
    out = {
        "agpl-3.0-section-13": (
            "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a "
            "computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version"
        ),
        "apache-2.0-whole-notice": (
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
            "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
            "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
        ),
        "bsd": "Released under the BSD License.",
        "bsd-style-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "isc": "Released under the ISC License.",
        "mit-line": "Licensed under the MIT License.",
        "mpl-2.0-notice": (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
            "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
        ),
    }
    for short, (name, versions) in _GNU.items():
        for version in versions:
            full = version if "." in version else f"{version}.0"
            out[f"{short}-{full}-notice"] = _GNU_TERMS.format(name=name, version=version)
            out[f"{short}-{full}"] = f"This work is licensed under the GNU {name}, version {version}."
    for version in ("3.0", "4.0"):
        kind = "International" if version == "4.0" else "Unported"
        for short, name in _CC.items():
            out[f"cc-{short}-{version}"] = f"Licensed under CC {short.upper()} {version}."
            out[f"cc-{short}-{version}-notice"] = f"This work is licensed under a Creative Commons {name} {version} {kind} License."
    return out | {f"spdx:{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}


def texts() -> dict[str, str]:
    """Whole texts up to their terms' end; files beside this module, which only the driver reads."""
    return {path.stem: path.read_text(encoding="utf-8") for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
