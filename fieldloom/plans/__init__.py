"""The extraction plan: geometry, matching, reading, diagnostics."""
