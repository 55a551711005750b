"""Where elements, regions and extract indexes come from."""
