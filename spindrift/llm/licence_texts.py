"""Public licence texts and notices, as templates for license scans.

Each paragraph of a text is a template of its own, named by one or more key phrases in it.
Short notices and identifier lines follow from the names and identifiers by rule.
"""

from __future__ import annotations

#: Fixed values: (label, key phrases, any of which names the licence, paragraph of the licence or of its standard notice).
PARAGRAPHS = (
    ("mit", ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy"), 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",), "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "permission to use copy modify and or distribute this software"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd", ("with or without fee is hereby granted the software is provided as is",), 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE'),
    ("bsd", ("redistribution and use in source and binary forms",), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", ("redistributions of source code must retain the above copyright notice",), "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", ("redistributions in binary form must reproduce the above copyright notice",), "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3", ("may be used to endorse or promote products derived from this software without specific prior written permission",), "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-4", ("all advertising materials mentioning features or use of this software must display the following acknowledgement",), "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("apache-2.0", ("licensed under the apache license version 2 0",), 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache-2.0", ("apache license version 2 0 january 2004",), "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("mpl-2.0", ("subject to the terms of the mozilla public license v 2 0",), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl-2.0", ("under the terms of the eclipse public license 2 0", "under the terms of the eclipse public license v 2 0"), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0. This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("gpl-3", ("gnu general public license as published by the free software foundation either version 3 of the license",), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", ("gnu general public license as published by the free software foundation either version 2 of the license",), "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", ("gnu general public license version 3 29 june 2007",), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-2", ("gnu general public license version 2 june 1991",), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl", ("gnu lesser general public license as published by the free software foundation",), "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", ("gnu affero general public license as published by the free software foundation",), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("zlib", ("in no event will the authors be held liable for any damages arising from the use of this software",), "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", ("the origin of this software must not be misrepresented",), "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."),
    ("bsl-1.0", ("obtaining a copy of the software and accompanying documentation covered by this license",), 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software'),
    ("unlicense", ("this is free and unencumbered software released into the public domain", "released into the public domain"), "This is free and unencumbered software released into the public domain."),
    ("wtfpl", ("do what the fuck you want to public license",), "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
    ("cc0", ("cc0 1 0 universal",), "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"),
    ("cc0", ("has waived all copyright and related or neighboring rights",), "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by", ("creative commons attribution 4 0 international license",), "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", ("creative commons attribution sharealike 4 0 international license",), "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", ("creative commons attribution noncommercial 4 0 international license",), "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", ("creative commons attribution noderivatives 4 0 international license",), "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike 4 0 international license",), "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", ("creative commons attribution noncommercial noderivatives 4 0 international license",), "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)
#: Names by which short notices call a licence.
NAMES = {
    "mit": ("mit license", "mit licence", "mit expat license"),
    "apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0"),
    "bsd": ("bsd license", "bsd licence"),
    "bsd-2": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "bsd-3": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "isc": ("isc license",),
    "mpl-2.0": ("mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0"),
    "epl-2.0": ("eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license version 2 0"),
    "gpl-2": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl v2"),
    "gpl-3": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl v3"),
    "lgpl": ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl v3"),
    "agpl": ("gnu affero general public license", "gnu agpl", "agpl v3"),
    "zlib": ("zlib license", "zlib libpng license"),
    "bsl-1.0": ("boost software license",),
    "unlicense": ("the unlicense",),
    "cc0": ("cc0 1 0", "cc0 public domain dedication"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike"),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution noncommercial sharealike"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution noncommercial noderivatives"),
    "cc-by": ("creative commons attribution license", "creative commons attribution 4 0"),
}
#: SPDX identifiers of each label, as words.
IDENTIFIERS = {
    "mit": ("mit",),
    "apache-2.0": ("apache 2 0",),
    "bsd-2": ("bsd 2 clause",),
    "bsd-3": ("bsd 3 clause",),
    "bsd-4": ("bsd 4 clause",),
    "0bsd": ("0bsd",),
    "isc": ("isc",),
    "mpl-2.0": ("mpl 2 0",),
    "epl-2.0": ("epl 2 0",),
    "gpl-2": ("gpl 2 0",),
    "gpl-3": ("gpl 3 0",),
    "lgpl": ("lgpl 2 1", "lgpl 3 0", "lgpl 2 0"),
    "agpl": ("agpl 3 0",),
    "zlib": ("zlib",),
    "bsl-1.0": ("bsl 1 0",),
    "unlicense": ("unlicense",),
    "wtfpl": ("wtfpl",),
    "cc0": ("cc0 1 0",),
    "cc-by": ("cc by 4 0", "cc by 3 0"),
    "cc-by-sa": ("cc by sa 4 0", "cc by sa 3 0"),
    "cc-by-nc": ("cc by nc 4 0", "cc by nc 3 0"),
    "cc-by-nd": ("cc by nd 4 0", "cc by nd 3 0"),
    "cc-by-nc-sa": ("cc by nc sa 4 0", "cc by nc sa 3 0"),
    "cc-by-nc-nd": ("cc by nc nd 4 0", "cc by nc nd 3 0"),
}

#: (label, key phrases, text) of every template.
TEMPLATES = (
    *PARAGRAPHS,
    *((label, (name,), name) for label, names in NAMES.items() for name in names),
    *((label, (f"spdx license identifier {name}",), f"spdx license identifier {name}") for label, names in IDENTIFIERS.items() for name in names),
)
