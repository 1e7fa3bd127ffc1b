"""Script for ``spark-submit``; see ``--help`` for the settings."""

from basketflow.__main__ import main

if __name__ == "__main__":
    main()
