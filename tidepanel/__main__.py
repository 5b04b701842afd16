from tidepanel.plans.commands import main

main()
