"""Result, manifest and search-export writers."""
