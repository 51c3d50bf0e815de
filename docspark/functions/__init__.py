"""See the modules of this folder."""
