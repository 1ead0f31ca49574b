"""plans of weft."""
