"""Wordings of licence notices, by SPDX identifier. Short ones name a licence, long ones grant it."""

NOTICES = {
    "MIT (named)": "Released under the MIT License.",
    "Apache-2.0 (named)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (named)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 (named)": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 (named)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 (named)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 (named)": "Released under the Mozilla Public License, version 2.0.",
    "BSD-3-Clause (named)": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 (named)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (named)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (named)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and
        related or neighboring rights to this work.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "BSD-3-Clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software.""",
}

# Standard notices of the neighbours of the above.
_FREE = ("This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
         "Foundation{next} either version {version} of the License, or (at your option) any later version.")
NOTICES |= {
    "AGPL-3.0-or-later": _FREE.format(mark=":", name="Affero General Public License", next=",", version="3"),
    "LGPL-3.0-or-later": _FREE.format(mark=":", name="Lesser General Public License", next=",", version="3"),
    "LGPL-2.1-or-later": _FREE.format(mark=";", name="Lesser General Public License", next=";", version="2.1"),
    "LGPL-2.0-or-later": _FREE.format(mark=";", name="Library General Public License", next=";", version="2"),
    "LGPL-3.0-or-later (library)": _FREE.format(mark=":", name="Lesser General Public License", next=",", version="3").replace("program", "library"),
    "LGPL-2.1-or-later (library)": _FREE.format(mark=";", name="Lesser General Public License", next=";", version="2.1").replace("program", "library"),
    "LGPL-2.1 (named)": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.",
    "EPL-2.0 (named)": "Licensed under the Eclipse Public License, version 2.0.",
    "MPL-1.1": """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in
        compliance with the License.""",
    "Artistic-2.0 (named)": "This package is licensed under the Artistic License 2.0.",
    "GFDL-1.3-or-later": """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any
        later version published by the Free Software Foundation.""",
}

# Creative Commons: every set of terms in both versions, named in short and in full.
_TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
          "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _short, _full in _TERMS.items():
    for _version, _kind in (("4.0", "International"), ("3.0", "Unported")):
        NOTICES.setdefault(f"CC-{_short}-{_version} (named)", f"Licensed under CC {_short} {_version}.")
        NOTICES.setdefault(f"CC-{_short}-{_version}", f"This work is licensed under a Creative Commons {_full} {_version} {_kind} License.")

# Words that tell licences with alike wordings apart, what stands before the number of a version, and what turns a notice into its opposite.
TELLING = frozenset("""gnu affero lesser library documentation lgpl agpl gpl apache mit bsd mozilla mpl eclipse epl artistic academic creative cc cc0
    sa nc nd sharealike noncommercial noderivatives noderivs attribution unlicense""".split())
VERSION_MARKS = frozenset("version v license licence by international unported".split())
NEGATIONS = frozenset("not never no isn without".split())
