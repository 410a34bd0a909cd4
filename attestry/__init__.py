"""attestry: table and stream jobs that turn document collections into sourced facts and audited answers."""
