"""plans of the package."""
