import sys

from .programs import main

sys.exit(main())
