import sys

from lacewing.cli import main

sys.exit(main())
