import sys

from ripplescope.cli import main

sys.exit(main())
