"""python -m plexus"""

import sys

from .cli import main

sys.exit(main())
