"""Tables kept up to date by streams of files."""
