import sys

from promptmatrix.cli import main

sys.exit(main())
