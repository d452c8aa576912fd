"""Writers. None replaces what is already there."""
