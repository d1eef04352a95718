"""Sources: session logs and binary resources."""
